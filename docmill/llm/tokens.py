"""Token counts and ids with public tokenizers, in Arrow batches.

Texts are never encoded one by one. A tokenizer that drops white space and
never joins what stands on its two sides makes every white space a safe
boundary: whole texts, however long, fall into words, a batch's new words are
encoded together, and known words come from a bounded table. Other
tokenizers get whole texts in batches balanced by bytes.
"""

from __future__ import annotations

import json
import os
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from docmill.llm.tasks import arrow_task, bounded_batches
from docmill.llm.textkernel import LOWER, column_bytes, mix, row_slices, word_hashes, word_spans

BATCH_BYTES = 4 << 20
TABLE_ENTRIES = 250_000  # about 50 MB a process, which outlives the task
SEEN_BITS = 22  # of the marks for words met before
LONGEST_KEPT_WORD = 64
JOINED_WORDS = 500
MARKS = ".,;:!?"

SLOT_BITS, POOL_IDS = 21, 8_000_000  # of a table of words in arrays: about 60 MB a process
LONGEST_MERGED_PIECE = 40
SIGN = np.zeros(256, bool)  # of ASCII, but for the one that starts pieces like 's
SIGN[[x for x in range(33, 127) if not chr(x).isalnum() and chr(x) != "'"]] = True

_encoders: dict[tuple, "Encoder"] = {}


def _spec(path: str) -> dict:
    with open(path, encoding="utf-8") as f:
        return json.load(f)


def _spaces_are_boundaries(path: str) -> bool:
    """Whether this .json drops white space before its merges and works word by word."""
    spec = _spec(path)
    pre = spec.get("pre_tokenizer") or {}
    steps = pre.get("pretokenizers", [pre])
    split = steps[0] if steps else {}
    pattern = split.get("pattern", {}).get("Regex", "")
    model = spec["model"]
    return (
        split.get("type") == "Split"
        and split.get("behavior") == "Removed"
        and bool(split.get("invert"))
        and "[^\\s" in pattern
        and "\\s+" not in pattern
        and " ?" not in pattern
        and bool(model.get("end_of_word_suffix"))
        and all(not s.get("add_prefix_space") for s in steps)
        and not any(t["lstrip"] or t["rstrip"] or any(c.isspace() for c in t["content"]) for t in spec.get("added_tokens", []))
    )


def _lowers(path: str) -> bool:
    """Whether this .json lower-cases texts and all its special strings contain <|."""
    spec = _spec(path)
    steps = (spec.get("normalizer") or {}).get("normalizers", [])
    return any(s.get("type") == "Lowercase" for s in steps) and all("<|" in t["content"] for t in spec.get("added_tokens", []))


class Encoder:
    """Batch encoder of one vocabulary file; kind 'length' keeps numbers of ids, 'ids' little-endian 32-bit ids."""

    def __init__(self, path: str, kind: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.kind, self.table, self.seen = kind, {}, bytearray(1 << SEEN_BITS)
        if path.endswith(".model"):
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=path)
            self.by_word = self.lowers = False
            self._ids = lambda texts: model.encode(texts, num_threads=1)
        else:
            from tokenizers import Tokenizer

            model = Tokenizer.from_file(path)
            model.no_truncation()
            model.no_padding()
            self.by_word, self.lowers = _spaces_are_boundaries(path), _lowers(path)
            self._ids = lambda texts: [e.ids for e in model.encode_batch_fast(texts, add_special_tokens=False)]
            if self.by_word:
                suffix = _spec(path)["model"]["end_of_word_suffix"]
                vocabulary = model.get_vocab(with_added_tokens=True)
                self.ends_word = np.zeros(max(vocabulary.values()) + 1, bool)
                self.ends_word[[i for w, i in vocabulary.items() if w.endswith(suffix)]] = True

    def _values(self, ids: np.ndarray, stops: np.ndarray) -> list:
        """What is kept of each part of ids, parts ending at stops."""
        at = [0, *stops.tolist()]
        if self.kind == "length":
            return [b - a for a, b in zip(at, at[1:])]
        raw = ids.astype("<u4").tobytes()
        return [raw[4 * a : 4 * b] for a, b in zip(at, at[1:])]

    def _parts(self, texts: list[str]) -> list:
        """Values of texts that are encoded one by one, in a batch."""
        found = self._ids(texts)
        return self._values(np.array([i for ids in found for i in ids], np.int64), np.cumsum([len(ids) for ids in found])) if texts else []

    def _words(self, words: list[bytes]) -> dict[bytes, object]:
        """Values of new words.

        Words of letters, and a mark after them, are encoded hundreds at a
        time as one text: each is one or two pieces for the merges, and the
        last id of a piece tells that it ends.
        """
        plain, pieces, other = [], [], []
        for w in words:
            text = w.decode()
            core = text[:-1] if text[-1] in MARKS else text
            if core.isascii() and core.isalpha() or core.isalpha() and core.lower().isalpha() and unicodedata.is_normalized("NFC", core):
                plain.append(w)
                pieces.append(2 if core is not text else 1)
            else:
                other.append(w)
        new = {}
        groups = range(0, len(plain), JOINED_WORDS)
        for a, found in zip(groups, self._ids([b" ".join(plain[a : a + JOINED_WORDS]).decode() for a in groups])):
            own = plain[a : a + JOINED_WORDS]
            ids = np.array(found, np.int64)
            ends = np.flatnonzero(self.ends_word[ids]) + 1
            last = np.cumsum(pieces[a : a + JOINED_WORDS])
            if len(ends) != last[-1]:
                other += own
            else:
                new.update(zip(own, self._values(ids, ends[last - 1])))
        new.update(zip(other, self._parts([w.decode() for w in other])))
        return new

    def texts(self, texts: list[bytes]) -> list[list]:
        """For each text the values of its parts, in order."""
        if not self.by_word:
            return [[x] for x in self._parts([t.decode() for t in texts])]
        if self.lowers:  # A and a are one word; special strings are matched in the text as it is
            texts = [t if b"<|" in t else t.lower() for t in texts]
        split = [t.split() for t in texts]
        get = self.table.get
        out = [list(map(get, words)) for words in split]
        holes = [i for i, values in enumerate(out) if None in values]
        if holes:
            new = self._words(list({w for i in holes for w, v in zip(split[i], out[i], strict=True) if v is None}))
            for i in holes:
                out[i] = [new[w] if v is None else v for w, v in zip(split[i], out[i], strict=True)]
            self._keep(new)
        return out

    def _keep(self, new: dict[bytes, object]) -> None:
        """Into the table go words met in an earlier batch too: most words of a corpus come once."""
        if len(self.table) < TABLE_ENTRIES:
            seen, mask = self.seen, (1 << SEEN_BITS) - 1
            for w, v in new.items():
                at = hash(w) & mask
                if seen[at]:
                    if len(w) <= LONGEST_KEPT_WORD:
                        self.table[w] = v
                else:
                    seen[at] = 1


def encoder(path: str, kind: str) -> Encoder:
    """This process's encoder; kind 'length' keeps lengths, 'ids' little-endian 32-bit ids."""
    if (path, kind) not in _encoders:
        _encoders[path, kind] = Encoder(path, kind)
    return _encoders[path, kind]


class Merges:
    """The merges of a vocabulary of bytes for many pieces of texts at once, as its library makes them: the least rank first, leftmost of equals."""

    def __init__(self, path: str):
        model = _spec(path)["model"]
        vocabulary, suffix = model["vocab"], model["end_of_word_suffix"]
        shown = dict(zip(range(256), map(chr, range(256))))  # how vocabularies of bytes write a byte
        hidden = [x for x in range(256) if x < 33 or 127 <= x <= 160 or x == 173]
        shown |= {x: chr(256 + i) for i, x in enumerate(hidden)}
        self.inner = np.array([vocabulary[shown[x]] for x in range(256)])
        self.last = np.array([vocabulary[shown[x] + suffix] for x in range(256)])
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.size, self.none = max(vocabulary.values()) + 1, len(pairs)
        keys = np.array([vocabulary[a] * self.size + vocabulary[b] for a, b in pairs])
        self.to = np.array([*(vocabulary[a + b] for a, b in pairs), -1])  # by rank
        self.bits = 20
        slot, free = self._slots(keys), np.full((1 << self.bits) + len(keys), -1, np.int64)
        self.keys, self.ranks = free, np.full(len(free), self.none, np.int32)
        left = np.arange(len(keys))
        while len(left):  # one key a free slot, the others one further
            at, first = np.unique(slot[left], return_index=True)
            open_ = self.keys[at] < 0
            own = left[first[open_]]
            self.keys[at[open_]], self.ranks[at[open_]] = keys[own], own
            left = np.setdiff1d(left, own)
            slot[left] += 1

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return (mix(keys.astype(np.uint64)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def _rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a * self.size + b
        at = self._slots(key)
        met = self.keys[at]
        left = np.flatnonzero((met != key) & (met >= 0))
        while len(left):
            at[left] += 1
            met = self.keys[at[left]]
            left = left[(met != key[left]) & (met >= 0)]
        return np.where(self.keys[at] == key, self.ranks[at], self.none)

    def ids(self, pieces: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, numbers of ids) of pieces of one length, given as rows of bytes; ids beyond a row's number are no ids."""
        n, width = pieces.shape
        s = self.inner[pieces]
        s[:, -1] = self.last[pieces[:, -1]]
        out, count = s.copy(), np.full(n, width)
        rows = np.arange(n)
        rank = self._rank(s[:, :-1].ravel(), s[:, 1:].ravel()).reshape(n, width - 1)
        while len(rows) and s.shape[1] > 1:
            at = rank.argmin(1)
            best = rank[np.arange(len(rows)), at]
            done = best == self.none
            if done.any():
                out[rows[done], : s.shape[1]] = s[done]
                count[rows[done]] = s.shape[1]
                s, rank, rows, at, best = s[~done], rank[~done], rows[~done], at[~done], best[~done]
            k, width = np.arange(len(rows)), s.shape[1] - 1
            column = np.arange(width)
            merged = np.take_along_axis(s, column + (column > at[:, None]), 1)
            merged[k, at] = self.to[best]
            s, ranks = merged, np.full((len(rows), max(width - 1, 1)), self.none, rank.dtype)
            if width > 1:
                column = np.arange(width - 1)
                ranks = np.take_along_axis(rank, column + (column >= at[:, None]), 1)
                before, after = np.flatnonzero(at > 0), np.flatnonzero(at < width - 1)
                ranks[before, at[before] - 1] = self._rank(s[before, at[before] - 1], s[before, at[before]])
                ranks[after, at[after]] = self._rank(s[after, at[after]], s[after, at[after] + 1])
            rank = ranks
        out[rows, : s.shape[1]] = s
        count[rows] = s.shape[1]
        return out, count


class WordIds:
    """Ids of whole batches of texts by the hashes of their words; for encoders that go by words and lower-case.

    New words of letters of Latin-1, signs of ASCII after them, meet the
    vocabulary's merges together; other words, and texts with special strings,
    are the encoder's.
    """

    def __init__(self, path: str):
        self.encoder, self.merges = encoder(path, "ids"), Merges(path)
        self._clear()

    def _clear(self) -> None:
        size = 1 << SLOT_BITS
        self.word, self.start, self.length = np.zeros(size, np.uint64), np.zeros(size, np.int32), np.zeros(size, np.int32)
        self.pool, self.used = np.zeros(0, np.uint16), 0

    def _encoded(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of the words one after the other, numbers of ids)."""
        two = (data >= 0x9F) & (data <= 0xBF) & (data != 0xB7)  # after C3 these are small letters
        two[1:] &= data[:-1] == 0xC3
        two[:1] = False
        letter = (data >= 97) & (data <= 122) | two
        letter[:-1] |= two[1:]
        letters = np.concatenate([[0], np.cumsum(letter)])
        signs = np.concatenate([[0], np.cumsum(SIGN[data])])
        core = letters[ends] - letters[starts]
        plain = (core + signs[ends] - signs[starts] == ends - starts) & (letters[starts + core] - letters[starts] == core)
        plain &= (core <= LONGEST_MERGED_PIECE) & (ends - starts - core <= LONGEST_MERGED_PIECE)
        own = np.flatnonzero(plain)
        word = np.concatenate([own, own])
        begin = np.concatenate([starts[own], starts[own] + core[own]])
        sizes = np.concatenate([core[own], (ends - starts - core)[own]])
        counts = np.zeros(len(starts), np.int64)
        pieces: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []  # words, whether signs, ids, numbers of ids
        head = np.zeros(len(starts), np.int64)  # ids of the letters
        for width in np.unique(sizes[sizes > 0]):
            at = np.flatnonzero(sizes == width)
            ids, n = self.merges.ids(data[begin[at][:, None] + np.arange(width)])
            second = at >= len(own)
            pieces.append((word[at], second, ids, n))
            head[word[at[~second]]] = n[~second]
            counts += np.bincount(word[at], weights=n, minlength=len(counts)).astype(np.int64)
        parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # words, columns, ids
        for at, second, ids, n in pieces:
            row, column = np.nonzero(np.arange(ids.shape[1]) < n[:, None])
            parts.append((at[row], column + (head[at] * second)[row], ids[row, column]))
        other = np.flatnonzero(~plain)
        words = [data[a:b].tobytes() for a, b in zip(starts[other].tolist(), ends[other].tolist())]
        found = self.encoder._words(words) if words else {}
        for i, w in zip(other.tolist(), words):
            ids = np.frombuffer(found[w], np.uint32)
            parts.append((np.full(len(ids), i), np.arange(len(ids)), ids))
            counts[i] = len(ids)
        at = np.cumsum(counts) - counts
        out = np.zeros(int(counts.sum()), np.uint16)
        for word, column, ids in parts:
            out[at[word] + column] = ids
        return out, counts

    def batch(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(ids of all texts as 16-bit numbers, where each text's begin, words' hashes, where each text's begin)."""
        low = LOWER[data]
        starts, ends, bounds = word_spans(low, offsets)
        words = word_hashes(low, starts, ends)
        if self.used > POOL_IDS:
            self._clear()
        slot = (words >> np.uint64(64 - SLOT_BITS)).astype(np.int64)
        at, n = self.start[slot], self.length[slot]
        missing = np.flatnonzero((self.word[slot] != words) | (n == 0))
        if len(missing):
            new, first, which = np.unique(words[missing], return_index=True, return_inverse=True)
            first = missing[first]
            ids, counts = self._encoded(low, starts[first], ends[first])
            if self.used + len(ids) > len(self.pool):
                self.pool = np.concatenate([self.pool[: self.used], np.zeros(len(ids) + (self.used >> 1), np.uint16)])
            self.pool[self.used : self.used + len(ids)] = ids
            begins = self.used + np.cumsum(counts) - counts
            self.used += len(ids)
            at[missing], n[missing] = begins[which], counts[which]
            free = np.flatnonzero(self.length[slot[first]] == 0)  # a slot keeps the word that came first
            own = slot[first[free]]
            own, one = np.unique(own, return_index=True)
            free = free[one]
            self.word[own], self.start[own], self.length[own] = new[free], begins[free], counts[free]
        stops = np.concatenate([[0], np.cumsum(n, dtype=np.int64)])
        out = self.pool[np.repeat(at - stops[:-1], n) + np.arange(stops[-1])]
        begins = stops[bounds]
        special = np.flatnonzero((data[:-1] == 60) & (data[1:] == 124))  # <|
        if len(special):
            texts = np.unique(np.searchsorted(offsets, special, "right") - 1)
            whole = [out[a:b] for a, b in zip(begins[:-1], begins[1:])]
            for i in texts.tolist():
                (parts,) = self.encoder.texts([data[offsets[i] : offsets[i + 1]].tobytes()])
                whole[i] = np.frombuffer(b"".join(parts), np.uint32).astype(np.uint16)
            out, begins = np.concatenate(whole), np.cumsum([0, *map(len, whole)])
        return out, begins, words, bounds


def word_ids(path: str) -> WordIds | None:
    """This process's WordIds of a vocabulary; None where it doesn't go by words, or doesn't lower-case."""
    if (path, "words") not in _encoders:
        whole = encoder(path, "ids")
        _encoders[path, "words"] = WordIds(path) if whole.by_word and whole.lowers else None
    return _encoders[path, "words"]


def text_batches(batch: pa.RecordBatch, text: str, most: int = BATCH_BYTES) -> Iterator[tuple[int, int, list[bytes]]]:
    """(first row, end row, texts as bytes) of a batch, balanced by bytes; null is empty."""
    data, offsets = column_bytes(batch.column(batch.schema.get_field_index(text)))
    raw = memoryview(data)
    for a, b in row_slices(offsets, most):
        at = offsets[a : b + 1].tolist()
        yield a, b, [bytes(raw[x:y]) for x, y in zip(at, at[1:])]


def token_counts(docs: DataFrame, tokenizer: str, *, id_col: str = "doc_id", text_col: str = "text", limit: int = 2048) -> DataFrame:
    """One row per row of docs: id_col, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit).

    A null text counts as empty: no bytes, no tokens. Rows with one id stay
    separate rows, a null id stays null, an empty table gives none, and other
    columns of docs (whatever their names) are not read.
    """

    bounded_batches(docs.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lengths = encoder(tokenizer, "length")
        for batch in batches:
            for a, b, texts in text_batches(batch, "text"):
                n = [sum(parts) for parts in lengths.texts(texts)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), pa.array(map(len, texts), pa.int64()), pa.array(n, pa.int64())],
                    ["doc_id", "n_bytes", "n_tokens"],
                )

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    out = rows.mapInArrow(arrow_task(count), "doc_id long, n_bytes long, n_tokens long")
    return out.select(F.col("doc_id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
