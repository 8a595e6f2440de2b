"""BPE encoding and decoding with content-defined chunk reuse.

A text is cut into chunks at white space where a rolling hash of the bytes before it hits a mask, so that equal passages
yield equal chunks wherever they stand. Each task keeps a store of chunks, bounded in bytes: while it is in the store, a chunk that documents
share is encoded once. A new chunk is put together from its words, the finest cut, whose codes are stored too; only words that are new go to
the tokenizer. Wherever two pieces meet, the characters on both sides are encoded together and apart, once for each pair of characters. Chunks
that do not agree where they meet are encoded again as one piece, which grows to both sides until it agrees with its neighbours: encoded
together with them it gives the same ids as apart.

All this holds for tokenizers that never look past the white space around a word (``by_words``); any other one gets whole texts.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import give_back, pieces_of, small_batches

#: Bytes that the rolling hash sees; a cut every 2 ** MASK_BITS white spaces on average.
WINDOW, MASK_BITS = 8, 5
#: Bytes of chunks and of words, with their codes, that a task remembers. A full store of chunks starts anew, one of words keeps what came again.
STORE_BYTES, WORD_BYTES = 8 << 20, 96 << 20
#: What an entry of chunks or of words costs besides its bytes and ids, about; pairs of characters that are remembered.
ENTRY_BYTES, WORD_ENTRY_BYTES, MOST_MEETS = 400, 240, 100_000
#: Texts that are coded together: rows and bytes.
PIECE_ROWS, PIECE_BYTES = 128, 1 << 20
#: Words that are encoded in one call.
TOGETHER = 512
#: Longer chunks are coded but not remembered.
MOST_BYTES = 1_000
#: A fixed odd multiplier of the polynomial rolling hash.
MULTIPLIER = 0x9E3779B97F4A7C15
#: White space that two pieces are tried with where they meet.
SPACINGS = (" ", "\n", "\t", "\r\n", "  ", "\x0b", "\x0c")

#: Steps of a tokenizer that treat each word alike, whatever stands beyond the white space around it.
PLAIN_NORMALIZERS = {"NFC", "NFD", "NFKC", "NFKD", "Lowercase", "StripAccents", "BertNormalizer"}
PLAIN_SPLITTERS = {"Whitespace", "WhitespaceSplit", "BertPreTokenizer", "Punctuation", "Digits"}

SPACES = np.zeros(256, dtype=bool)
SPACES[[9, 10, 11, 12, 13, 32]] = True


def cut_points(data: bytes) -> np.ndarray:
    """Where chunks end, in bytes: before ASCII white space, chosen by the bytes ahead of it."""
    if len(data) <= WINDOW:
        return np.zeros(0, np.int64)
    raw = np.frombuffer(data, dtype=np.uint8)
    space = SPACES[raw]
    at = np.flatnonzero(space[1:] & ~space[:-1]) + 1
    at = at[at >= WINDOW]
    rolling = np.zeros(len(at), dtype=np.uint64)
    for k in range(WINDOW):
        rolling *= np.uint64(MULTIPLIER)
        rolling += raw[at - WINDOW + k]
    rolling ^= rolling >> np.uint64(29)
    rolling *= np.uint64(MULTIPLIER)
    return at[(rolling >> np.uint64(64 - MASK_BITS)) == 0]


def flat(coded: list) -> np.ndarray:
    """Lists or arrays of ids as one."""
    return np.concatenate([np.asarray(ids, np.int32) for ids in coded]) if coded else np.zeros(0, np.int32)


def split_words(parts: list[bytes]) -> tuple[pa.Array, np.ndarray]:
    """The words of all parts, and how many there are up to the end of each part."""
    raw = np.frombuffer(b"\n".join([*parts, b""]), dtype=np.uint8)
    space = SPACES[raw]
    starts = np.flatnonzero(~space & np.concatenate([[True], space[:-1]]))
    ends = np.flatnonzero(space & np.concatenate([[False], ~space[:-1]]))
    offsets = np.concatenate([[0], np.cumsum(ends - starts)])
    words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(raw[~space])])
    return words, np.searchsorted(starts, np.cumsum([len(p) + 1 for p in parts]))


def spelled(names: pa.Array, ids: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> list[memoryview]:
    """The names of the ids of each stretch, joined by one space."""
    text = names.take(pa.array(ids))
    offsets, data = np.frombuffer(text.buffers()[1], np.int64), memoryview(text.buffers()[2] or b"")
    return [data[a : max(a, b - 1)] for a, b in zip(offsets[starts].tolist(), offsets[ends].tolist(), strict=True)]


def _steps(part: dict | None, inner: str) -> list[dict]:
    if part is None:
        return []
    return [s for p in part[inner] for s in _steps(p, inner)] if part["type"] == "Sequence" else [part]


def _local(step: dict) -> bool:
    """Whether the pattern of a step looks at nothing outside its match: no look-around, no anchors."""
    return re.search(r"\(\?[=!<]|\\[bBAzZGK]|(?<!\[)\^|\$", step["pattern"].get("Regex", "")) is None


def _inked(step: dict) -> bool:
    """Whether the pattern of a step can match no white space, as far as its form tells: what might, counts as if it does."""
    rest = re.sub(r"\[\^[^\]]*\\s[^\]]*\]", "", step["pattern"].get("Regex", " "))
    return re.search(r"\[\^|\\[sWDPHhvRXNOxunrt]|[\s.]", rest) is None


def by_words(spec: dict) -> bool:
    """Whether a tokenizer (its JSON form) encodes a text as its words apart: it splits at white space, keeps none of it, and no step
    looks around or changes a text's ends."""
    normal = all(s["type"] in PLAIN_NORMALIZERS or s["type"] == "Replace" and _local(s) for s in _steps(spec["normalizer"], "normalizers"))
    splits = _steps(spec["pre_tokenizer"], "pretokenizers")
    if not (normal and splits):
        return False
    first, *rest = splits
    # what lies between the matches goes: white space must not be part of one
    matches = first["type"] == "Split" and first["behavior"] == "Removed" and first["invert"] and _local(first) and _inked(first)
    after = all(s["type"] in PLAIN_SPLITTERS or s["type"] == "ByteLevel" and not s["add_prefix_space"] and not s["use_regex"] for s in rest)
    return after and (matches or first["type"] in PLAIN_SPLITTERS - {"Punctuation", "Digits"})


class ChunkCoder:
    """Encodes and decodes texts with one tokenizer and bounded stores of chunks and words."""

    def __init__(self, path: str, store: int = STORE_BYTES, words: int = WORD_BYTES):
        from tokenizers import Tokenizer

        t = self.tokenizer = Tokenizer.from_file(path)
        t.no_truncation()
        t.no_padding()
        self.most, self.most_words = store, words
        #: Without a decoder, decoded text is the tokens with spaces between; a decoder has to see all ids of a text.
        spec = json.loads(t.to_str())
        self.spaced, self.by_words = spec["decoder"] is None, by_words(spec)
        size = t.get_vocab_size(with_added_tokens=True)
        #: Each with a space behind.
        self.names, self.digits = (pa.array([x + " " for x in own], pa.large_string()) for own in ([t.id_to_token(i) or "" for i in range(size)], map(str, range(size))))
        special = {i: x.content for i, x in t.get_added_tokens_decoder().items() if x.special}
        #: A special token stands between words that are encoded in one call: it keeps them apart.
        self.fence = next(iter(special.items()), None)
        # a tokenizer that lower-cases sees a letter's two cases as one; special strings are matched before and must stay
        self.lowers = '"Lowercase"' in t.to_str() and all(x.content == x.content.lower() for x in t.get_added_tokens_decoder().values())
        self.marks = [x.content.encode() for x in t.get_added_tokens_decoder().values()]
        self.forget()

    def forget(self) -> None:
        """Empty all stores."""
        self.characters: dict[str, int] = {}
        self.meets: dict[tuple[int, int], bool] = {}
        self.store: dict[bytes, tuple] = {}
        self.stored = 0
        self.forget_words()

    def forget_words(self) -> None:
        """Words by number; the ids of all of them stand in one array, those of a word from its place on."""
        self.words: dict[bytes, int] = {}
        self.ids, self.n_ids = np.zeros(4096, np.int32), 0
        self.places, self.sizes, self.first, self.last = (np.zeros(1024, t) for t in (np.int64, np.int32, np.int32, np.int32))
        self.again = np.zeros(1024, bool)
        self.word_bytes = 0

    def forget_rare_words(self) -> None:
        """Keep the words that came again since the store was last thinned, if they leave half of it free: most words of a large
        corpus come once."""
        kept = np.flatnonzero(self.again[: len(self.words)])
        words = list(self.words)
        words = [words[i] for i in kept.tolist()]
        sizes, first, last, ids = self.sizes[kept], self.first[kept], self.last[kept], self.spread(kept)
        self.forget_words()
        if 0 < 2 * self.cost(words, len(ids)) <= self.most_words:
            self.add(words, ids, sizes, first, last)

    @staticmethod
    def cost(words: list[bytes], n_ids: int) -> int:
        return sum(map(len, words)) + 4 * n_ids + WORD_ENTRY_BYTES * len(words)

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words, and how many each has. Many words make one text, as a call costs more than a word."""
        if self.fence is None or any(self.fence[1][:2] in w for w in words):
            coded = self.encode(words)
            return flat(coded), np.array([len(ids) for ids in coded], np.int32)
        fence = self.fence[1]
        coded = self.encode([fence.join(words[at : at + TOGETHER]) + fence for at in range(0, len(words), TOGETHER)])
        ids = flat(coded)
        ends = np.flatnonzero(ids == self.fence[0])
        return ids[ids != self.fence[0]], (np.diff(ends, prepend=-1) - 1).astype(np.int32)

    def add(self, words: list[bytes], ids: np.ndarray, sizes: np.ndarray, first: np.ndarray, last: np.ndarray) -> None:
        """Append words to the store."""
        base, end, n = len(self.words), len(self.words) + len(words), self.n_ids + len(ids)
        if n > len(self.ids):
            self.ids = np.resize(self.ids, n + n // 2)
        if end > len(self.sizes):
            self.places, self.sizes, self.first, self.last, self.again = (np.resize(x, end + end // 2) for x in (self.places, self.sizes, self.first, self.last, self.again))
        self.ids[self.n_ids : n] = ids
        self.places[base:end] = self.n_ids + np.cumsum(sizes, dtype=np.int64) - sizes
        self.sizes[base:end], self.first[base:end], self.last[base:end], self.again[base:end] = sizes, first, last, False
        self.words.update(zip(words, range(base, end), strict=True))
        self.n_ids = n
        self.word_bytes += self.cost(words, len(ids))

    def learn(self, fresh: list[bytes]) -> None:
        """Store new words."""
        texts, number = b"\n".join(fresh).decode().split("\n"), self.characters
        first, last = ([number.setdefault(t[k], len(number)) for t in texts] for k in (0, -1))
        self.add(fresh, *self.encode_words(texts), first, last)

    def spread(self, index: np.ndarray) -> np.ndarray:
        """The ids of the words of these numbers, one after the other."""
        sizes = self.sizes[index]
        before = np.cumsum(sizes, dtype=np.int64) - sizes
        return self.ids[np.repeat(self.places[index] - before, sizes) + np.arange(sizes.sum(dtype=np.int64))]

    def agree(self, last: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Whether pieces that meet at these characters encode together as they do apart, whatever the white space."""
        pairs, place = np.unique(last << 32 | first, return_inverse=True)
        ok = np.ones(len(pairs), bool)
        names = None
        for k, pair in enumerate(pairs.tolist()):
            meet = pair >> 32, pair & 0xFFFFFFFF
            if (known := self.meets.get(meet)) is None:
                names = names or list(self.characters)
                a, b = names[meet[0]], names[meet[1]]
                x, y, *both = self.encode([a, b, *[a + s + b for s in SPACINGS]])
                known = self.meets[meet] = all(x + y == z for z in both)
            ok[k] = known
        return ok[place]

    def whole(self, part: bytes) -> tuple:
        """The code of a piece that the tokenizer sees as one."""
        text = part.decode()
        inner, number = text.strip(" \t\n\x0b\x0c\r"), self.characters
        if not inner:
            return ()
        return flat(self.encode([text])), number.setdefault(inner[0], len(number)), number.setdefault(inner[-1], len(number))

    def numbers(self, words: pa.Array) -> np.ndarray:
        """The number of each word in the store, where new ones are put first."""
        coded = words.dictionary_encode()
        distinct, known = coded.dictionary.to_numpy(zero_copy_only=False).tolist(), len(self.words)
        at = list(map(self.words.get, distinct))
        if fresh := [w for w, k in zip(distinct, at, strict=True) if k is None]:
            self.learn(fresh)
            at = list(map(self.words.__getitem__, distinct))
        at = np.array(at, np.int64)
        self.again[at[at < known]] = True
        return at[coded.indices.to_numpy()]

    def chunks(self, parts: list[bytes]) -> dict[bytes, tuple]:
        """Codes of new chunks: ids, first and last character; () without words."""
        if not parts:
            return {}
        words, ends = split_words(parts)
        index = self.numbers(words)
        first, last = self.first[index].astype(np.int64), self.last[index].astype(np.int64)
        inner = np.ones(max(len(index) - 1, 0), bool)
        inner[ends[:-1][(ends[:-1] > 0) & (ends[:-1] < len(index))] - 1] = False  # where two chunks stand beside one another
        bad = np.zeros(len(index) + 1, np.int64)
        if inner.any():
            bad[1:-1][inner] = ~self.agree(last[:-1][inner], first[1:][inner])
        ids, total = self.spread(index), np.concatenate([[0], np.cumsum(self.sizes[index], dtype=np.int64)])
        starts = np.concatenate([[0], ends[:-1]])
        bad = np.cumsum(bad)
        broken = bad[np.maximum(ends - 1, 0)] > bad[starts]
        first, last = np.append(first, 0)[starts], np.append(last, 0)[ends - 1]
        out: dict[bytes, tuple] = {}
        for p, lo, hi, again, a, b, x, y in zip(parts, *(v.tolist() for v in (starts, ends, broken, total[starts], total[ends], first, last)), strict=True):
            if hi == lo:
                out[p] = ()
            else:
                out[p] = self.whole(p) if again else (ids[a:b], x, y)
        return out

    def code(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after the other, and where those of each end."""
        if not self.by_words:
            coded = self.encode([t.encode("utf-8", "replace").decode() for t in texts])
            return flat(coded), np.cumsum([len(ids) for ids in coded], dtype=np.int64)
        datas = [t.encode("utf-8", "replace") for t in texts]
        if self.lowers:
            low = [d.lower() for d in datas]  # A-Z only
            datas = [d if any(m in x for m in self.marks) else x for d, x in zip(datas, low, strict=True)]
        cuts = cut_points(b"\n".join(datas))
        parts, at = [], 0
        for data in datas:
            lo, hi = np.searchsorted(cuts, (at + 1, at + len(data)))
            ends = [*(cuts[lo:hi] - at).tolist(), len(data)]
            parts.append([data[a:b] for a, b in zip([0, *ends], ends, strict=False)])
            at += len(data) + 1
        made = self.chunks(list(dict.fromkeys(p for own in parts for p in own if p not in self.store)))
        pieces = [[made[p] if p in made else self.store[p] for p in own] for own in parts]
        inked = [[k for k, p in enumerate(own) if p] for own in pieces]
        meets = [(d, a, b) for d, own in enumerate(inked) for a, b in zip(own, own[1:], strict=False)]
        if meets:
            ok = self.agree(np.array([pieces[d][a][2] for d, a, _ in meets]), np.array([pieces[d][b][1] for d, _, b in meets]))
            apart: dict[int, list[tuple[int, int]]] = {}
            for d, a, b in (meets[k] for k in np.flatnonzero(~ok).tolist()):
                apart.setdefault(d, []).append((a, b))
            for d, joins in apart.items():
                pieces[d] = self.repaired(parts[d], pieces[d], joins)
        ids = flat([p[0] for own in pieces for p in own if p])
        self.remember(made)
        return ids, np.cumsum([sum(len(p[0]) for p in own if p) for own in pieces], dtype=np.int64)

    def code_parts(self, texts: list[str]) -> tuple[list[int], list, list]:
        """Number of tokens, ids as text and decoded text of each text, both in UTF-8."""
        ids, ends = self.code(texts)
        starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
        if self.spaced:
            decoded = spelled(self.names, ids, starts, ends)
        else:
            decoded = [self.tokenizer.decode(ids[a:b].tolist(), skip_special_tokens=False).encode() for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
        return (ends - starts).tolist(), spelled(self.digits, ids, starts, ends), decoded

    def code_batch(self, texts: list[str]) -> list[tuple[int, str, str]]:
        """Number of tokens, ids as text and decoded text of each text."""
        return [(n, str(a, "utf-8"), str(b, "utf-8")) for n, a, b in zip(*self.code_parts(texts), strict=True)]

    def remember(self, made: dict[bytes, tuple]) -> None:
        """Store new chunks; full stores start anew."""
        short = {p: v and (v[0].copy(), *v[1:]) for p, v in made.items() if len(p) <= MOST_BYTES}
        self.store.update(short)
        self.stored += sum(len(p) + (4 * len(v[0]) if v else 0) + ENTRY_BYTES for p, v in short.items())
        if self.stored > self.most:
            self.store, self.stored = {}, 0
        if self.word_bytes > self.most_words:
            self.forget_rare_words()
        if len(self.meets) > MOST_MEETS:
            self.forget()

    def repaired(self, parts: list[bytes], pieces: list[tuple], joins: list[tuple[int, int]]) -> list[tuple]:
        """The pieces of a text of which those at the bad ``joins`` (places of the two that meet) are encoded again as one.

        A stretch of chunks grows by one to both sides until it agrees with what stands beside it, the text's ends at last.
        """
        windows: list[tuple[int, int, tuple]] = []
        for first, second in joins:
            if windows and second < windows[-1][1]:
                continue
            lo, hi = first, second + 1
            while True:
                left, right = max(lo - 1, 0), min(hi + 1, len(parts))
                if windows and left < windows[-1][1]:  # two stretches that meet are one
                    lo = windows.pop()[0]
                    continue
                mine = self.whole(b"".join(parts[lo:hi]))
                apart = flat([p[0] for p in (*pieces[left:lo], mine, *pieces[hi:right]) if p])
                if (left, right) == (lo, hi) or np.array_equal(self.whole(b"".join(parts[left:right]))[0], apart):
                    break
                lo, hi = left, right
            windows.append((lo, hi, mine))
        out, done = [], 0
        for lo, hi, mine in windows:
            out += [*pieces[done:lo], mine]
            done = hi
        return out + pieces[done:]


#: Coders of this worker process, by path. Their stores end with a task, so that an idle worker holds the tokenizer only.
_CODERS: dict[str, ChunkCoder] = {}


def coder_of(path: str) -> ChunkCoder:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    if path not in _CODERS:
        _CODERS[path] = ChunkCoder(path)
    return _CODERS[path]


def encode(docs: DataFrame, path: str, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Ids and decoded text of every row's ``text``: the columns ``keep``, ``n_tokens long, ids string`` (decimal ids
    joined by one space) and ``decoded string``.

    One map over the rows; the tokenizer is read at ``path`` on each executor. A null or empty text has no tokens and two empty strings.
    Repeated rows give repeated results; columns other than ``keep`` are not read.
    """
    added = [T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.StringType()), T.StructField("decoded", T.StringType())]
    schema = T.StructType([*[docs.schema[c] for c in keep], *added])
    small_batches(docs.sparkSession)
    return docs.select(*keep, docs["text"].alias("__text")).mapInArrow(_coder(path, len(keep), False), schema)


def encode_digests(docs: DataFrame, path: str) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256``: the digests of what ``encode`` returns, made where it is made."""
    small_batches(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(_coder(path, 1, True), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def _coder(path: str, n_keep: int, digests: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = coder_of(path)
        try:
            yield from code(coder, batches)
        finally:
            coder.forget()
            give_back()

    def code(coder: ChunkCoder, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ("n_tokens", "ids_sha256", "decoded_sha256") if digests else ("n_tokens", "ids", "decoded")
        for batch in batches:
            for piece in pieces_of(batch, n_keep, PIECE_ROWS, PIECE_BYTES):
                n, *made = coder.code_parts([t or "" for t in piece.column(n_keep).to_pylist()])
                say = (lambda x: hashlib.sha256(x).hexdigest()) if digests else (lambda x: str(x, "utf-8"))
                new = [pa.array(n, pa.int64()), *[pa.array(list(map(say, x)), pa.string()) for x in made]]
                yield pa.RecordBatch.from_arrays([*[piece.column(k) for k in range(n_keep)], *new], names=[*piece.schema.names[:n_keep], *names])

    return run
