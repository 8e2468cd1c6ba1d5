"""BPE encoding and decoding with a pair occurrence index.

The distinct pretokens of a part of the partition lie in one symbol array. An index maps the rank of each mergeable adjacent
pair to all its positions; the lowest active rank is applied at all of them, and the pairs that this makes are entered in the
lists of their own ranks, until no list is left. Documents are then put together from their pretokens' ids.
"""

from __future__ import annotations

import heapq
import json
import unicodedata
from collections import defaultdict

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.llm.base import bounded_batches, lean, query, table

#: Bytes of text that share one pair index; a longer text has an index of its own.
FLUSH_BYTES = 2 << 20
#: Places whose pairs are entered at once when an index is begun.
ENTER = 1 << 17


class WordBpe:
    """A BPE vocabulary with word ends over byte-level symbols (lower case, white space dropped), read from its JSON text."""

    def __init__(self, text: str):
        spec = json.loads(text)
        model = spec["model"]
        vocab, end = model["vocab"], model["end_of_word_suffix"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.token = [""] * (1 + max([*vocab.values(), *self.special.values()]))
        for t, i in [*vocab.items(), *self.special.items()]:
            self.token[i] = t
        pattern = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.pattern = regex.compile(pattern.replace(r"\s", r"\p{White_Space}") + "|\n")
        self.special_pattern = regex.compile("|".join(map(regex.escape, self.special))) if self.special else None
        self.marks = [s[:2] for s in self.special]
        # byte-level alphabet: printable bytes stand for themselves, the others for the code points from 256 on
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        other = iter(range(256, 512))
        char = [chr(b) if b in plain else chr(next(other)) for b in range(256)]
        self.inner = np.array([vocab[c] for c in char], np.int32)
        self.last = np.array([vocab[c + end] for c in char], np.int32)
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        pair = np.array([vocab[a] << 32 | vocab[b] for a, b in merges], np.int64)
        self.by_pair = np.argsort(pair, kind="stable")
        self.pair = pair[self.by_pair]
        self.made = np.array([vocab[a + b] for a, b in merges], np.int32)
        self.same = np.array([a == b for a, b in merges])

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair of symbols, -1 where the vocabulary has no such merge."""
        key = left.astype(np.int64) << 32 | right
        at = np.minimum(np.searchsorted(self.pair, key), len(self.pair) - 1)
        return np.where(self.pair[at] == key, self.by_pair[at], -1)

    def encode_pretokens(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct pretokens: (offsets, ids)."""
        data = [w.encode("utf-8") for w in words]
        size = np.array([len(w) for w in data], np.int64)
        first = np.r_[0, np.cumsum(size)]
        n = int(first[-1])
        byte = np.frombuffer(b"".join(data), np.uint8)
        sym = self.inner[byte]
        if n:
            sym[first[1:] - 1] = self.last[byte[first[1:] - 1]]
        # right[i]: the next symbol of the same word or n; left[i]: the one before or -1
        right, left = np.arange(1, n + 1, dtype=np.int32), np.arange(-1, n - 1, dtype=np.int32)
        if n:
            right[first[1:] - 1] = n
            left[first[:-1]] = -1
        alive = np.ones(n + 1, bool)
        at = np.flatnonzero(right < n).astype(np.int32)
        lists: dict[int, list[np.ndarray]] = defaultdict(list)
        heap: list[int] = []

        def enter(pos: np.ndarray) -> None:
            """Add the pairs that start at ``pos`` to the index."""
            rank = self.ranks(sym[pos], sym[right[pos]])
            pos = pos[rank >= 0]
            rank = rank[rank >= 0]
            if not len(pos):
                return
            order = np.argsort(rank, kind="stable")
            rank, pos = rank[order], pos[order]
            cut = np.flatnonzero(rank[1:] != rank[:-1]) + 1
            for r, p in zip(rank[np.r_[0, cut]].tolist(), np.split(pos, cut) if len(cut) else [pos]):
                if r not in lists:
                    heapq.heappush(heap, r)
                lists[r].append(p)

        for i in range(0, len(at), ENTER):
            enter(at[i:i + ENTER])
        while heap:
            r = heapq.heappop(heap)
            found = lists.pop(r)
            pos = found[0] if len(found) == 1 else np.unique(np.concatenate(found))
            key = self.pair_of(r)
            to = right[pos]
            ok = alive[pos] & (to < n)
            pos, to = pos[ok], to[ok]
            ok = (sym[pos].astype(np.int64) << 32 | sym[to]) == key
            pos, to = pos[ok], to[ok]
            if self.same[r] and len(pos) > 1:
                # of a run x x x x every second pair from the left is merged
                pos.sort()
                chained = np.r_[False, right[pos[:-1]] == pos[1:]]
                start = np.maximum.accumulate(np.where(chained, 0, np.arange(len(pos))))
                pos = pos[(np.arange(len(pos)) - start) % 2 == 0]
                to = right[pos]
            if not len(pos):
                continue
            sym[pos] = self.made[r]
            alive[to] = False
            after = right[to]
            right[pos] = after
            inside = after < n
            left[after[inside]] = pos[inside]
            before = left[pos]
            enter(np.unique(np.concatenate([pos[inside], before[before >= 0]])))
        keep = np.flatnonzero(alive[:n])
        return np.searchsorted(keep, first), sym[keep]

    def pair_of(self, rank: int) -> int:
        if not hasattr(self, "_pairs"):
            self._pairs = np.empty(len(self.pair), np.int64)
            self._pairs[self.by_pair] = self.pair
        return self._pairs[rank]

    def chunks(self, text: str) -> list:
        """White-space-free pieces of a text, lower-cased; special tokens are their ids."""
        if any(m in text for m in self.marks) and (hits := list(self.special_pattern.finditer(text))):
            out, at = [], 0
            for m in hits:
                out += [*self.chunks_plain(text[at:m.start()]), self.special[m[0]]]
                at = m.end()
            return out + self.chunks_plain(text[at:])
        return self.chunks_plain(text)

    @staticmethod
    def chunks_plain(text: str) -> list[str]:
        if not unicodedata.is_normalized("NFC", text):
            text = unicodedata.normalize("NFC", text)
        text = text.replace("Σ", "σ").lower()
        # str.split() also cuts at these four, which are no white space in Unicode
        if any(c in text for c in "\x1c\x1d\x1e\x1f"):
            return [x for x in regex.split(r"\p{White_Space}+", text) if x]
        return text.split()

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text (None: no ids)."""
        number: dict = {}
        docs = [np.fromiter([number.setdefault(c, len(number)) for c in self.chunks(t)] if t else [], np.int64) for t in texts]
        kinds = list(number)
        plain = [i for i, c in enumerate(kinds) if isinstance(c, str)]
        pre: dict[str, int] = {"\n": -1}
        seq = np.fromiter((pre.setdefault(p, len(pre) - 1) for p in self.pattern.findall("\n".join(map(kinds.__getitem__, plain)))), np.int64)
        del pre["\n"]
        off, ids = self.encode_pretokens(list(pre))
        # chunk -> pretokens -> ids
        ends = np.flatnonzero(seq < 0)
        first = np.r_[0, ends + 1]
        last = np.r_[ends, len(seq)]
        flat, length = gather(off, ids, seq[seq >= 0])
        at = np.r_[0, np.cumsum(length)]
        shift = np.arange(len(first))
        lo, hi = at[first - shift], at[last - shift]
        spans = np.zeros((len(kinds), 2), np.int64)
        if plain:
            spans[plain, 0], spans[plain, 1] = lo, hi
        extra = [i for i, c in enumerate(kinds) if not isinstance(c, str)]
        for k, i in enumerate(extra):
            spans[i] = len(flat) + k, len(flat) + k + 1
        values = np.r_[flat, [kinds[i] for i in extra]].astype(np.int64) if extra else flat
        out = []
        for d in docs:
            a, b = spans[d, 0], spans[d, 1]
            out.append(take(values, a, b - a))
        return out

    def decode(self, ids: np.ndarray) -> str:
        """Tokens joined by blanks: the file names no decoder, so word ends and byte-level symbols stay as they are."""
        return " ".join(map(self.token.__getitem__, ids.tolist()))


def take(values: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Concatenation of ``values[start:start + length]`` over all entries."""
    total = int(length.sum())
    before = np.cumsum(length) - length
    return values[np.repeat(start - before, length) + np.arange(total)]


def gather(off: np.ndarray, values: np.ndarray, idx: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    length = off[idx + 1] - off[idx]
    return take(values, off[idx], length), length


def load(spark: SparkSession, path: str):
    """The vocabulary file, read once by the driver and broadcast (its size is fixed)."""
    with open(path, encoding="utf-8") as f:
        return spark.sparkContext.broadcast(f.read())


def encode(docs: DataFrame, path: str, decoded: bool = False) -> DataFrame:
    """``doc_id, ids`` of every row of ``docs(doc_id, text)``; ids is binary, little-endian unsigned 32-bit.

    With ``decoded`` the ids are decoded again in the same task, as ``decode`` does, into a column of that name.

    Whole texts, whatever their length. A null or empty text has no ids. Rows that repeat, also by doc_id, and null doc_ids are rows
    like others; other columns are ignored; an empty table gives an empty result.
    """
    bounded_batches(docs.sparkSession)
    spec = load(docs.sparkSession, path)

    @lean
    def run(batches):
        bpe = WordBpe(spec.value)
        keys, texts, total = [], [], 0

        def flush():
            ids = bpe.encode(texts)
            cols = [pa.array(keys, pa.int64()), pa.array([x.astype("<u4").tobytes() for x in ids], pa.binary())]
            if decoded:
                cols.append(pa.array((bpe.decode(x) for x in ids), pa.string(), size=len(ids)))
            return pa.RecordBatch.from_arrays(cols, names=["doc_id", "ids", "decoded"][:len(cols)])

        for batch in batches:
            for key, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                keys.append(key)
                texts.append(text)
                total += len(text or "")
                if total >= FLUSH_BYTES:
                    yield flush()
                    keys, texts, total = [], [], 0
        if keys:
            yield flush()

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, ids binary" + ", decoded string" * decoded)


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """Adds ``decoded`` to ``doc_id, ids``."""
    spec = load(encoded.sparkSession, path)

    @lean
    def run(batches):
        bpe = WordBpe(spec.value)
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                text = [bpe.decode(np.frombuffer(x.as_buffer(), "<u4")) for x in part.column("ids")]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(text, pa.string())], names=["doc_id", "ids", "decoded"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, ids binary, decoded string")


def digests(docs: DataFrame, path: str) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` of every row."""
    out = encode(docs, path, decoded=True)
    return out.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"),
                      F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


@query("op7_pair_index_bpe")
def op7(spark, sf_dir):
    import public_tokenizers

    return digests(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
