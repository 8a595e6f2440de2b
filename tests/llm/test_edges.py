"""Defined results for nulls, empty and very long texts, ties, repeated rows, empty tables and clashing extra columns."""

import json

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lanewise.llm import bpe, chat, embed_dedup, langid, line_dedup, mixing, ngram_join, quality, queries, secrets, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LONG = " ".join(f"token{k % 977} über" for k in range(40_000))
ROWS = [
    (1, "Plain text of a few words that stands here\nand a second line of it", "en", "a", 10),
    (2, "Plain text of a few words that stands here\nand a second line of it", "en", "a", 10),
    (2, "Plain text of a few words that stands here\nand a second line of it", "en", "a", 10),
    (3, None, "en", "b", None),
    (4, "", None, None, 0),
    (5, " \t\n ", "de", None, 4),
    (None, "text without an id but with some words", "de", "b", 5),
    (None, None, None, None, None),
    (6, LONG, "fr", "c", len(LONG)),
    (7, "été " * 30, "fr", "c", 120),
    (8, "12345 67890", "es", "a", 11),
]


@pytest.fixture(scope="module")
def odd(spark):
    table = spark.createDataFrame(ROWS, SCHEMA)
    clashes = ("size", "key", "taken", "row", "words", "id", "rid", "leaf", "drop", "node", "label", "grams", "score", "held_out", "t", "w", "l", "target", "epochs")
    return table.withColumns({c: F.lit("x") for c in clashes})


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (6, 1, 1), (6, 0, 0), (None, 1, 1), (7, None, None)], "doc_id long, quality int, toxic int")


def by_id(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.doc_id, []).append(r)
    return out


def test_mixing(odd, none):
    got = by_id(mixing.mix_sizes(odd))
    assert [len(v) for _, v in sorted(got.items(), key=str)] == [1, 2, 1, 1, 1, 1, 1, 1, 2]
    assert got[3][0].size == got[4][0].size == got[5][0].size == 0
    assert got[6][0].size == 80_000
    assert all(r.taken <= 3 * r.size for v in got.values() for r in v)
    assert mixing.mix_documents(odd).columns == odd.columns
    assert mixing.mix_sizes(none).count() == mixing.mix_documents(none).count() == 0


def test_mixing_cuts_after_the_last_word_taken(spark):
    """Of 12 words the source of weight 1 gets 4: one document whole or cut, and no white space behind the cut."""
    texts = {1: "a1\tb1\n c1 \x0b d1", 2: "a2 \n\n b2\tc2\r\nd2", 3: "x\ty z\n w"}
    table = spark.createDataFrame([(i, t, "en", "b" if i == 3 else "a", len(t)) for i, t in texts.items()], SCHEMA)
    want = {r.doc_id: r.taken for r in mixing.mix_sizes(table).collect()}
    got = {}
    for r in mixing.mix_documents(table).collect():
        got[r.doc_id] = got.get(r.doc_id, 0) + len(brute.words(r.text))
        assert texts[r.doc_id].startswith(r.text) and r.text == r.text.rstrip(" \t\n\x0b\x0c\r") and r.n_chars == len(r.text)
    assert got == {i: n for i, n in want.items() if n}


def test_mixing_shares_ties_evenly(spark):
    rows = [(1, "one two three", "en", "a", 13)] * 4 + [(2, "a b c d e f", "en", "b", 11)]
    got = [(r.doc_id, r.target, r.taken) for r in mixing.mix_sizes(spark.createDataFrame(rows, SCHEMA)).collect()]
    # six of twelve words are left for four equal rows: one each, rounded down
    assert sorted(got) == [(1, 6.0, 1)] * 4 + [(2, 12.0, 12)]


def test_mixing_without_words(spark):
    empty = spark.createDataFrame([(1, "", "en", "a", 0), (2, None, "en", None, 0)], SCHEMA)
    assert {r.taken for r in mixing.mix_sizes(empty).collect()} == {0}
    assert mixing.mix_documents(empty).count() == 0


def test_salted_plan_agrees_with_broadcast(odd, monkeypatch):
    want = sorted(map(str, mixing.mix_sizes(odd).collect()))
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 0)
    assert sorted(map(str, mixing.mix_sizes(odd).collect())) == want


def test_line_dedup(odd, none):
    got = by_id(line_dedup.dedup_lines(odd))
    assert sum(map(len, got.values())) == len(ROWS)
    assert got[1][0].n_dropped == 0 and [r.text for r in got[2]] == ["", ""]
    assert got[3][0].text is None and got[4][0].text == "" and got[5][0].text == " \t\n "
    assert got[6][0].text == LONG
    assert line_dedup.dedup_documents(odd).columns == odd.columns
    assert line_dedup.dedup_lines(none).count() == 0


def test_exact_copies_of_lines_without_template_are_dropped(spark):
    shared = ["Menu", "Read more", "12 34 56 78 x", "一行没有空格的文字"]
    table = spark.createDataFrame([(1, "\n".join(["first one", *shared, "", "7 a"])), (2, "\n".join(["", *shared, "menu", "8 a"])), (None, "Menu\n \nown")], "doc_id long, text string")
    assert {r.doc_id: r.text for r in line_dedup.dedup_documents(table).collect()} == {1: table.first().text, 2: "\nmenu\n8 a", None: " \nown"}


def test_line_dedup_takes_ids_of_any_type(spark):
    line = "Posted by anna in the city forum for all readers"
    texts = [("b9", line), ("b10", f"own words here\n{line}"), (None, line), ("a", None)]
    got = {r.doc_id: r.text for r in line_dedup.dedup_lines(spark.createDataFrame(texts, "doc_id string, text string")).collect()}
    assert got == {"b10": texts[1][1], "b9": "", None: "", "a": None}  # by the order of texts, null last
    floats = spark.createDataFrame([(2.5, line), (2.25, line)], "doc_id double, text string")
    assert {r.doc_id: r.text for r in line_dedup.dedup_lines(floats).collect()} == {2.25: line, 2.5: ""}
    small = spark.createDataFrame([(2, line), (1, line)], "doc_id int, text string")
    assert {r.doc_id: r.text for r in line_dedup.dedup_documents(small).collect()} == {1: line, 2: ""}


def test_line_dedup_by_least_number_of_documents(spark):
    rows = [(1, "the cat sat up\nshared by three"), (2, "the cat sat down\nshared by three"), (3, "shared by three\nshared by three"), (3, "shared by three")]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    two = sorted((r.doc_id, r.text) for r in line_dedup.dedup_lines(table).collect())
    three = sorted((r.doc_id, r.text) for r in line_dedup.dedup_lines(table, documents=3).collect())
    assert two == [(1, rows[0][1]), (2, ""), (3, ""), (3, "")]
    assert three == [(1, rows[0][1]), (2, "the cat sat down"), (3, ""), (3, "")]
    assert sorted((r.doc_id, r.text) for r in line_dedup.dedup_lines(table, documents=4).collect()) == sorted(rows)


def test_line_leaves_in_generated_code(spark):
    """Leaves are made by projections, not by functions over arrays, which Spark interprets; odd white space and fields stay as they were."""
    same = [["a b c d e f g h"], ["a\tb c\x0bd e\rf  g h ", "  a b\x0cc d e f g h"], ["a b c d e f g <*>", "a b c d e f g 1"], ["x", " x"], ["<*> 1 2 w"], ["", " \t "]]
    rows = [(100 * g + k, t) for g, texts in enumerate(same) for k, t in enumerate(texts)]
    leaves = line_dedup.line_leaves(spark.createDataFrame(rows, "doc_id long, text string"))
    assert "lambda" not in leaves._jdf.queryExecution().toString()
    got = {}
    for r in leaves.collect():
        got.setdefault(r.id, set()).add((r.leaf, r.more))
    assert {i: len(x) for i, x in got.items()} == {0: 3, 100: 3, 101: 3, 200: 3, 201: 3, 300: 1, 301: 1, 400: 1}
    assert got[0] == got[100] == got[101] and got[200] == got[201]
    assert len(got[0] & got[200]) == 1 and got[300] != got[301]


def test_bpe_gives_whole_texts_to_tokenizers_that_look_around(spark, monkeypatch, tmp_path):
    words, bytes_ = queries.tokenizer_path(), queries.tokenizer_path("byte_bpe_50k.json")
    assert bpe.ChunkCoder(words).by_words and not bpe.ChunkCoder(bytes_).by_words
    spec = json.loads(open(words).read())
    for pattern, fine in ((r"\p{L}+|\S", True), (r"\p{L}+(?!\s)|\S", False), (r"\s?\p{L}+", False), (r"^\p{L}+|\S", False), (r"[^\s]+", True)):
        spec["pre_tokenizer"]["pretokenizers"][0]["pattern"] = {"Regex": pattern}
        assert bpe.by_words(spec) == fine, pattern
    spec["pre_tokenizer"] = None
    assert not bpe.by_words(spec)
    texts = ["", "one two  three\n\n four", "it's 1234 " * 50, "日本 é e\u0301 <|endoftext|> x", " \t"]
    coder = bpe.ChunkCoder(bytes_)
    for text, (n, ids, decoded) in zip(texts, coder.code_batch(texts), strict=True):
        want = coder.tokenizer.encode(text, add_special_tokens=False).ids
        assert (n, ids) == (len(want), " ".join(map(str, want))) and decoded == coder.tokenizer.decode(want, skip_special_tokens=False)
    got = {r.doc_id: r.decoded for r in bpe.encode(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), bytes_).collect()}
    assert got == dict(enumerate(texts))


def test_ngram_join(odd, none):
    got = by_id(ngram_join.classes(odd))
    assert sum(map(len, got.values())) == len(ROWS)
    assert {r.component_id for r in got[1] + got[2]} == {1}
    assert got[3][0].n_shingles == got[4][0].n_shingles == got[5][0].n_shingles == 0
    assert got[5][0].component_id == 5 and got[8][0].n_shingles == 1
    kept = ngram_join.keep_one(odd)
    assert kept.columns == odd.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(["1", "3", "4", "5", "6", "7", "8", "None", "None"])
    assert ngram_join.classes(none).count() == 0


def test_words_that_a_polynomial_hash_confuses_are_different(spark):
    thue = "a"
    for _ in range(9):
        thue += thue.translate(str.maketrans("ab", "ba"))
    table = spark.createDataFrame([(1, thue), (2, thue.translate(str.maketrans("ab", "ba")))], "doc_id long, text string")
    assert {(r.doc_id, r.component_id) for r in ngram_join.classes(table).collect()} == {(1, 1), (2, 2)}


def test_word_hashes_of_a_long_text_in_pieces(monkeypatch):
    text = ("Ein Wort\tund noch\n eines \x0b" * 200 + "x" * 900 + " end").encode()
    whole = ngram_join.word_hashes(text)
    monkeypatch.setattr(ngram_join, "PIECE_BYTES", 64)
    assert len(whole) == len(text.split()) and (ngram_join.word_hashes(text) == whole).all()


def test_keep_one_tells_rows_apart_by_id_and_text(spark):
    a, b, c = (" ".join(f"{x}{k}" for k in range(40)) for x in "abc")
    rows = [(1, a), (None, a), (2, a + " more"), (2, b), (None, c), (None, c), (None, c + " more"), (3, ""), (None, ""), (4, "alone " + b[::-1]), (4, "alone " + b[::-1])]
    table = spark.createDataFrame([(i, t, "en", f"s{k}", len(t)) for k, (i, t) in enumerate(rows)], SCHEMA)
    kept = ngram_join.keep_one(table)
    assert kept.columns == table.columns
    got = [(r.doc_id, r.text) for r in kept.collect()]
    null_c = [t for i, t in got if i is None and t]
    assert len(null_c) == 1 and null_c[0] in (c, c + " more")
    assert sorted(map(str, got)) == sorted(map(str, [(1, a), (2, b), (None, null_c[0]), (3, ""), (None, ""), rows[9]]))


def test_quality(odd, none):
    got = by_id(quality.with_quality(odd))
    assert got[3][0].n_words == 0 and got[3][0].base_failed and not got[3][0].kept
    assert got[6][0].n_words == 80_000
    assert got[7][0].n_repeat_words == 30
    assert quality.with_quality(none).count() == 0


def test_bpe(odd, none):
    path = queries.tokenizer_path()
    got = by_id(bpe.encode(odd, path))
    assert (got[3][0].n_tokens, got[3][0].ids, got[3][0].decoded) == (0, "", "")
    assert got[2][0] == got[2][1] and got[6][0].n_tokens > 80_000
    assert bpe.encode(none, path).count() == 0


def test_bpe_special_strings_and_joins():
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(queries.tokenizer_path())
    tok.no_truncation()
    coder = bpe.ChunkCoder(queries.tokenizer_path(), store=2_000, words=4_000)
    texts = ["a <|startoftext|> b<|endoftext|>c", "É é ́x", "İstanbul ΣΑΣ ΟΔΟΣ 's don't", "x y z　w " * 40, "word " * 500, "a" * 9000 + " b", "\r\n\t" * 30, "1 2 3 " * 300 + "fin"]
    for text in texts * 2:
        ids = tok.encode(text, add_special_tokens=False).ids
        assert coder.code_batch([text]) == [(len(ids), " ".join(map(str, ids)), tok.decode(ids, skip_special_tokens=False))]
    assert coder.code_batch(texts) == [coder.code_batch([t])[0] for t in texts]


def test_bpe_pieces_without_new_chunks(spark):
    rows = [(k, t) for k, t in enumerate([None] * 300 + [""] * 300 + ["one known text\nof two lines"] * 300)]
    got = bpe.encode(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1), queries.tokenizer_path()).collect()
    assert len(got) == 900 and len({(r.n_tokens, r.ids, r.decoded) for r in got}) == 2
    assert {r.n_tokens for r in got if r.doc_id < 600} == {0} and {r.n_tokens for r in got if r.doc_id >= 600} == {6}


def test_bpe_repairs_joins_that_do_not_agree(monkeypatch):
    """Whatever joins are held to be bad, the repaired ids are the tokenizer's."""
    import random

    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(queries.tokenizer_path())
    tok.no_truncation()
    coder, rng, repairs = bpe.ChunkCoder(queries.tokenizer_path()), random.Random(3), []
    monkeypatch.setattr(bpe, "cut_points", lambda data: np.array([k for k in range(9, len(data)) if data[k : k + 1].isspace() and not data[k - 1 : k].isspace()], np.int64))
    monkeypatch.setattr(coder, "agree", lambda last, first: (lambda ok: ok & [rng.random() < 0.8 for _ in ok])(bpe.ChunkCoder.agree(coder, last, first)))
    monkeypatch.setattr(coder, "repaired", lambda *a: repairs.append(1) or bpe.ChunkCoder.repaired(coder, *a))
    parts = ["don't", "É", "́x", "Σ", "<|endoftext|>", " ", "\n", "\t \n", " ", "12", "…", "über", "한국"]
    for _ in range(60):
        text = "".join(rng.choice(parts) + rng.choice(["", " "]) for _ in range(rng.randint(0, 90)))
        ids = tok.encode(text, add_special_tokens=False).ids
        assert coder.code_batch([text]) == [(len(ids), " ".join(map(str, ids)), tok.decode(ids, skip_special_tokens=False))]
    assert len(repairs) > 20


def test_bpe_store_holds_its_bytes_of_words():
    """A word costs the store its ids, not two texts of them: what fits is learned once; what does not is still right."""
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(queries.tokenizer_path())
    tok.no_truncation()
    words = [f"w{chr(97 + k % 26)}{chr(97 + k // 26 % 26)}{chr(97 + k // 676)}" for k in range(5_000)]
    texts = [" ".join(words[k : k + 50]) for k in range(0, 5_000, 50)] + ["\u200b x \ufffd\x00 \x85 y", "", " \n "]
    want = [tok.encode(t, add_special_tokens=False).ids for t in texts]
    want = [(len(ids), " ".join(map(str, ids)), tok.decode(ids, skip_special_tokens=False)) for ids in want]
    for size, all_fit in ((1_400_000, True), (300_000, False)):
        coder = bpe.ChunkCoder(queries.tokenizer_path(), store=10_000, words=size)
        for _ in range(2):
            assert [x for k in range(0, len(texts), 10) for x in coder.code_batch(texts[k : k + 10])] == want
        assert (len(coder.words) > 5_000) == all_fit


def test_language(odd, none):
    got = by_id(langid.identify(odd))
    assert [r.lang_pred for r in got[3] + got[4] + got[5] + got[8]] == ["und"] * 4
    assert got[None][0].held_out and sum(map(len, got.values())) == len(ROWS)
    assert langid.identify(none).count() == 0
    assert {r.lang_pred for r in langid.predict(odd, {}).collect()} == {"und"}


def test_language_with_one_short_document_leaves_the_others_alone(spark, sf_dir):
    table = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    stray = next(i for i in range(10**9, 10**9 + 100) if not brute.held_out(i))
    for lang, text in (("aa", "kri olmu"), ("zz", "x")):
        more = table.unionByName(spark.createDataFrame([(stray, text, lang)], table.schema))
        dicts = langid.dictionaries(langid.sample_texts(more))
        assert dicts[lang] == text.encode() and {k: v for k, v in dicts.items() if k != lang} == langid.dictionaries(langid.sample_texts(table))
        truth = {r.doc_id: r.lang for r in table.where("lang is not null").collect()}
        rows = [r for r in langid.predict(more, dicts).collect() if r.held_out and r.doc_id in truth and r.lang_pred != "und"]
        assert len(rows) > 20 and sum(r.lang_pred == truth[r.doc_id] for r in rows) / len(rows) > 0.9


@pytest.mark.parametrize("ids", [1, 10])
def test_no_language_is_lost_to_repeated_rows(spark, ids):
    free = [i for i in range(10**6, 10**6 + 200) if not brute.held_out(i)]
    for at in range(0, 60, 10):  # whatever the hash of an id says
        repeated = spark.range(10_000).select(F.element_at(F.array(*[F.lit(i) for i in free[at : at + ids]]), (F.col("id") % ids + 1).cast("int")).cast("long").alias("doc_id"), F.lit("kri olmu bes tura").alias("text"), F.lit("aa").alias("lang"))
        many = spark.range(5_000).select(F.col("id").alias("doc_id"), F.concat(F.lit("the word "), F.translate(F.col("id").cast("string"), "0123456789", "abcdefghij")).alias("text"), F.lit("bb").alias("lang"))
        samples = langid.sample_texts(repeated.unionByName(many))
        assert set(samples) == {"aa", "bb"} and samples["aa"] == ["kri olmu bes tura"] * ids and len(samples["bb"]) == langid.SAMPLE_ROWS


def test_languages_without_letters_and_very_many(spark):
    free = [i for i in range(300) if not brute.held_out(i)]
    rows = [(free[0], "123 456", "nn"), (free[1], "7" * 3_000 + " wort", "dd"), (free[2], "wort " * 3, "ee")]
    samples = langid.sample_texts(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert set(samples) == {"dd", "ee"} and samples["dd"] == ["wort"]
    many = spark.createDataFrame([(free[k % 9], f"w{chr(97 + k % 26)}", f"l{k:04}") for k in range(2 * langid.LANGUAGES)] + [(free[k], "often " + "ab"[k % 2], "zz") for k in range(9)], "doc_id long, text string, lang string")
    samples = langid.sample_texts(many)
    assert len(samples) == langid.LANGUAGES and "zz" in samples


def test_embeddings(spark):
    table = spark.createDataFrame([(1, [1.0, 0.0]), (1, [2.0, 0.0]), (2, [1.0, 0.0]), (None, [0.0, 1.0]), (3, [0.0, 2.0])], "vec_id long, embedding array<float>").withColumns({"node": F.lit(1), "unit": F.lit(2), "dim": F.lit(3)})
    got = [tuple(r) for r in embed_dedup.near_duplicates(table).orderBy("vec_id").collect()]
    assert got == [(None, 1, 3, False), (1, 2, 1, True), (1, 2, 1, True), (2, 2, 1, False), (3, 1, 3, True)]
    assert embed_dedup.near_duplicates(table.limit(0)).count() == 0


def test_chat(spark):
    table = spark.createDataFrame([(1, 0, "user", None), (1, 0, "user", None), (1, None, None, "x"), (None, 1, "assistant", "y"), (None, 2, "assistant", "")], "conv_id long, turn long, role string, text string").withColumns({"node": F.lit(1), "up": F.lit(2), "c": F.lit(3)})
    back = {r.conv_id: r for r in chat.read_back(chat.format_conversations(chat.turns_as_tree(table))).collect()}
    assert [(t.role, t.text) for t in back[1].turns] == [("", "x"), ("user", ""), ("user", "")]
    assert back[None].loss_text == "y"
    assert chat.format_conversations(chat.turns_as_tree(table.limit(0))).count() == 0


def test_secrets(odd, none):
    got = by_id(secrets.scan(odd))
    assert got[3][0].spans == "" and sum(map(len, got.values())) == len(ROWS)
    assert secrets.scan(none).count() == 0


def test_toxicity(odd, none, labels):
    model = toxicity.learn(odd, labels)
    got = by_id(toxicity.score(odd, model))
    assert sum(map(len, got.values())) == len(ROWS)
    assert got[3][0].score == got[4][0].score
    assert toxicity.keep_clean(odd, model).columns == odd.columns
    assert toxicity.score(none, toxicity.learn(none, labels)).count() == 0
    assert toxicity.learn(odd, labels.limit(0)).weights == {}


def test_pipeline_against_brute_force(spark, sf_dir):
    """Every stage again in plain Python, on its predecessor's plain result; only the fitted weights are the engine's."""
    import hashlib
    import math
    from collections import Counter

    from test_operators import _brute_lines
    from tokenizers import Tokenizer

    table = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = toxicity.learn(table, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    docs = {r.doc_id: (r.source, r.text) for r in table.collect()}
    assert len(docs) == table.count() and all(t is not None for _, t in docs.values())
    docs = {i: d for i, d in docs.items() if model.bias + sum(model.weights.get(h, 0.0) for h in toxicity.hashed(toxicity.feature_names(toxicity.word_set(d[1]))).view(np.uint64).tolist()) < 0}
    lines = _brute_lines([(i, t) for i, (_, t) in docs.items()])
    docs = {i: (s, lines[i]) for i, (s, _) in docs.items()}
    n, component, _ = brute.jaccard_components([(i, t) for i, (_, t) in docs.items()], 5, 80)
    docs = {i: d for i, d in docs.items() if n[i] == 0 or component[i] == i}
    sizes = Counter()
    for s, t in docs.values():
        sizes[s] += len(brute.words(t))
    target, mixed = brute.mix_targets(dict(sizes)), []
    for source in sizes:
        epochs = min(3, math.floor(target[source] / sizes[source])) if sizes[source] else 0
        left = round(target[source] - epochs * sizes[source]) if epochs < 3 else 0
        for i in sorted((i for i in docs if docs[i][0] == source), key=lambda i: (hashlib.md5(f"mix:{i}".encode()).hexdigest(), i)):
            text, words = docs[i][1], brute.words(docs[i][1])
            if not words:
                continue
            mixed += [(i, text)] * epochs
            if left >= len(words):
                mixed.append((i, text))
            elif left > 0:
                mixed.append((i, text[: [m.end() for m in brute.WORD.finditer(text)][left - 1]]))
            left = max(0, left - len(words))
    tok = Tokenizer.from_file(queries.tokenizer_path())
    tok.no_truncation()
    tok.no_padding()
    want = Counter()
    for i, text in mixed:
        ids = tok.encode(text, add_special_tokens=False).ids
        want[i, len(ids), " ".join(map(str, ids)), tok.decode(ids, skip_special_tokens=False)] += 1
    got = Counter((r.doc_id, r.n_tokens, r.ids, r.decoded) for r in corpus_pipeline.run(spark, sf_dir).collect())
    assert got == want and len(got) > 100


def test_pipeline_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    first = docs
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, sf_dir).cache()
        assert docs.count() > 0, name
        if k < len(corpus_pipeline.STAGES) - 1:
            assert docs.schema.names == first.schema.names and [f.dataType for f in docs.schema] == [f.dataType for f in first.schema], name
    assert corpus_pipeline.run(spark, sf_dir).count() == docs.count()


def test_pipeline_on_odd_rows(spark, tmp_path, labels):
    spark.createDataFrame(ROWS, SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() >= 1
