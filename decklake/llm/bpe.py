"""Byte-level BPE on Spark.

The distinct words of the corpus are counted; the frequent ones (a bounded dictionary) are merged by a fold of
Spark's higher-order functions over their bytes, with the ranks as one literal map. Tasks then look up the
distinct words of a batch and gather the ids of all. The rest, rare words and words longer than ``FOLD_BYTES``
bytes, are merged where they stand, by the same ranks; both give the same ids.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import json
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from decklake.llm.common import bound, small_batches, stored, whole_text

#: Most words in the dictionary that is sent to all tasks, and most bytes of a word that is folded.
DICTIONARY_WORDS, FOLD_BYTES = 262_144, 64
_BUCKETS, _NONE = 1 << 15, 2**31 - 1
#: The white space of the pattern's \s, which Java's own lacks.
WHITE = r"\t-\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"


def read_ranks(path: str) -> dict[bytes, int]:
    """Ranks of a file with a base64 token and its rank on each line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


def java_pattern(pattern: str) -> str:
    """``pattern`` for Java's engine: \\s and \\S spelled out."""
    out, inside, i = [], False, 0
    while i < len(pattern):
        two = pattern[i : i + 2]
        if two == r"\s":
            out.append(WHITE if inside else f"[{WHITE}]")
        elif two == r"\S" and not inside:
            out.append(f"[^{WHITE}]")
        elif two[0] == "\\":
            out.append(two)
        else:
            inside = two[0] == "[" or inside and two[0] != "]"
            out.append(two[0])
            i -= 1
        i += 2
    return "".join(out)


def rank_map(ranks: dict[bytes, int]) -> Column:
    """The ranks as a literal: an array of small maps, entered by a hash of the key. Keys are bytes as Latin-1."""
    maps: list[dict[str, int]] = [{} for _ in range(_BUCKETS)]
    for token, rank in ranks.items():
        key = token.decode("latin-1")
        maps[xxhash.xxh64_intdigest(key.encode(), 42) & (_BUCKETS - 1)][key] = rank
    return F.from_json(F.lit(json.dumps(maps)), "array<map<string,int>>")


def folded(word: Column, ranks: Column) -> Column:
    """The ids of a word: its bytes, then merge after merge of the adjacent pair of least rank, leftmost first.

    The fold's state has the parts, the rank of each pair of neighbours, and the place of the least rank (0: none).
    """

    def ids(raw: Column, ranks: Column) -> Column:
        n = F.length(raw)

        def rank(key: Column) -> Column:
            return F.try_element_at(F.get(ranks, F.xxhash64(key).bitwiseAND(_BUCKETS - 1).cast("int")), key)

        def ranked(key: Column) -> Column:
            return F.coalesce(rank(key), F.lit(_NONE))

        def state(parts: Column, pairs: Column) -> Column:
            def least(p: Column) -> Column:
                low = F.array_min(p)
                return F.struct(parts.alias("parts"), p.alias("pairs"), F.when(low < _NONE, F.array_position(p, low).cast("int")).otherwise(0).alias("at"))

            return bound(pairs, least)

        def merge(s: Column, _: Column) -> Column:
            parts, pairs, at = s["parts"], s["pairs"], s["at"]

            def put(joined: Column) -> Column:
                none = F.array().cast("array<int>")
                left = F.when(at > 1, F.array(ranked(F.concat(F.get(parts, at - 2), joined)))).otherwise(none)
                right = F.when(at < F.size(pairs), F.array(ranked(F.concat(joined, F.get(parts, at + 1))))).otherwise(none)
                before, after = F.slice(pairs, F.lit(1), F.greatest(at - 2, F.lit(0))), F.slice(pairs, at + 2, n)
                return state(F.concat(F.slice(parts, F.lit(1), at - 1), F.array(joined), F.slice(parts, at + 2, n)), F.concat(before, left, right, after))

            return F.when(at > 0, bound(F.concat(F.get(parts, at - 1), F.get(parts, at)), put)).otherwise(s)

        letters = F.transform(F.sequence(F.lit(1), n), lambda i: F.substr(raw, i, F.lit(1)))
        pairs = F.transform(F.sequence(F.lit(1), n - 1), lambda i: ranked(F.substr(raw, i, F.lit(2))))
        end = F.aggregate(F.sequence(F.lit(2), n), state(letters, pairs), merge, lambda s: F.transform(s["parts"], rank))
        return F.when(n == 0, F.array().cast("array<int>")).otherwise(bound(rank(raw), lambda r: F.when(r.isNotNull() | (n == 1), F.array(r)).otherwise(end)))

    raw = F.decode(F.encode(word, "UTF-8"), "ISO-8859-1")
    return bound(F.struct(raw.alias("raw"), ranks.alias("ranks")), lambda x: ids(x["raw"], x["ranks"]))


def merged(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same ids for a word that is not in the dictionary: by a search of the least pair, in long words by a heap."""
    if word in ranks:
        return [ranks[word]]
    if len(word) > FOLD_BYTES:
        return merged_by_heap(word, ranks)
    parts = [word[i : i + 1] for i in range(len(word))]
    pairs = [ranks.get(word[i : i + 2], _NONE) for i in range(len(word) - 1)]
    while pairs and (low := min(pairs)) < _NONE:
        i = pairs.index(low)
        joined = parts[i] + parts[i + 1]
        parts[i : i + 2] = [joined]
        del pairs[i]
        if i:
            pairs[i - 1] = ranks.get(parts[i - 1] + joined, _NONE)
        if i < len(pairs):
            pairs[i] = ranks.get(joined + parts[i + 1], _NONE)
    return [ranks[p] for p in parts]


def merged_by_heap(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same in n log n time."""
    if word in ranks:
        return [ranks[word]]
    end = list(range(1, len(word) + 1))
    before = list(range(-1, len(word) - 1))
    alive = [True] * len(word)
    heap: list[tuple[int, int, int]] = []

    def offer(i: int) -> None:
        j = end[i]
        if j < len(word) and (r := ranks.get(word[i : end[j]])) is not None:
            heapq.heappush(heap, (r, i, end[j]))

    for i in range(len(word)):
        offer(i)
    while heap:
        _, i, stop = heapq.heappop(heap)
        j = end[i]
        if not alive[i] or j >= len(word) or end[j] != stop:
            continue
        alive[j] = False
        end[i] = stop
        if stop < len(word):
            before[stop] = i
        offer(i)
        if before[i] >= 0:
            offer(before[i])
    return [ranks[word[i : end[i]]] for i in range(len(word)) if alive[i]]


def word_counts(docs: DataFrame, pattern: str, text: str = "text") -> DataFrame:
    """(word, n) over whole texts; tasks count before the shuffle."""
    words = F.regexp_extract_all(whole_text(text), F.lit(java_pattern(pattern)), F.lit(0))
    return docs.select(F.explode(words).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))


def frequent(counts: DataFrame, most: int = DICTIONARY_WORDS) -> DataFrame:
    """The words of ``counts`` above the least frequency (in steps of a sixteenth of an octave) that at most ``most`` words have."""
    counts = counts.where(F.octet_length("word") <= FOLD_BYTES).withColumn("step", F.floor(F.log2("n") * 16).cast("int"))
    sizes = sorted(((r.step, r.words) for r in counts.groupBy("step").agg(F.count(F.lit(1)).alias("words")).collect()), reverse=True)
    least, total = None, 0
    for step, words in sizes:
        total += words
        if total > most:
            break
        least = step
    return counts.where("false" if least is None else f"step >= {least}").select("word")


def dictionary(docs: DataFrame, ranks: dict[bytes, int], pattern: str, text: str = "text", most: int = DICTIONARY_WORDS) -> DataFrame:
    """(word, ids) of frequent words: at most ``most`` words of ``FOLD_BYTES`` bytes."""
    words = frequent(stored(word_counts(docs, pattern, text), "bpe-words"), most).repartition(64)
    return stored(words.select("word", folded(F.col("word"), rank_map(ranks)).alias("ids")), "bpe-dictionary")


def packed(table: pa.Table) -> bytes:
    """A small table as an Arrow file."""
    sink = pa.BufferOutputStream()
    with pa.ipc.new_file(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_table(table)
    return sink.getvalue().to_pybytes()


class Vocabulary:
    """The dictionary and the ranks in a worker: words, where each word's ids begin and how many they are, all ids."""

    _held: dict[str, Vocabulary] = {}

    def __init__(self, table: pa.Table, ranks: dict[bytes, int]):
        table = table.combine_chunks()
        self.ranks = ranks
        if len(table):
            self.words, ids = table.column("word").chunk(0), table.column("ids").chunk(0)
            ends = ids.offsets.to_numpy().astype(np.int64)
            self.start, self.size, self.ids = ends[:-1], np.diff(ends), ids.values.to_numpy(zero_copy_only=False).astype(np.int32)
        else:
            self.words = pa.array([], pa.string())
            self.start, self.size, self.ids = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)

    @classmethod
    def of(cls, known: Broadcast) -> Vocabulary:
        """Unpacked once in a worker."""
        key, content, ranks = known.value
        if key not in cls._held:
            cls._held = {key: cls(pa.ipc.open_file(content).read_all(), ranks)}
        return cls._held[key]

    def encode(self, rows: pa.ListArray) -> pa.ListArray:
        """The ids of the words of each row: distinct words are looked up, the ids of all are gathered by place."""
        bounds = rows.offsets.to_numpy()
        coded = rows.values.slice(bounds[0], bounds[-1] - bounds[0]).dictionary_encode()
        distinct = coded.dictionary
        place = pc.index_in(distinct, value_set=self.words)
        rare = np.flatnonzero(place.is_null().to_numpy(zero_copy_only=False))
        at = place.fill_null(0).to_numpy()
        start, size = np.zeros(len(distinct), np.int64), np.zeros(len(distinct), np.int64)
        if len(self.words):
            start[:], size[:] = self.start[at], self.size[at]
        more = [merged(w.encode(), self.ranks) for w in distinct.take(pa.array(rare)).to_pylist()]
        size[rare] = [len(x) for x in more]
        start[rare] = len(self.ids) + np.cumsum([0, *size[rare]])[:-1]
        ids = np.concatenate([self.ids, np.fromiter((i for x in more for i in x), np.int32)])
        words = coded.indices.to_numpy()
        sizes = size[words]
        ends = np.concatenate([np.zeros(1, np.int64), np.cumsum(sizes)])
        places = np.arange(ends[-1]) + np.repeat(start[words] - ends[:-1], sizes)
        return pa.ListArray.from_arrays(pa.array(ends[bounds - bounds[0]].astype(np.int32)), pa.array(ids[places]))


def encode(docs: DataFrame, ranks: dict[bytes, int], pattern: str, text: str = "text", column: str = "token_ids", most: int = DICTIONARY_WORDS) -> DataFrame:
    """``docs`` with an array column of the ids of each whole text.

    Every match of ``pattern`` is encoded by itself; there are no special tokens. Null and empty texts have
    no ids. Repeated rows stay; other columns pass (one named as ``column`` is replaced).
    """
    spark = docs.sparkSession
    known = spark.sparkContext.broadcast((uuid.uuid4().hex, packed(dictionary(docs, ranks, pattern, text, most).toArrow()), ranks))
    small_batches(spark, 4 << 20)

    @F.arrow_udf("array<int>")
    def look_up(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        vocabulary = Vocabulary.of(known)
        for batch in batches:
            yield vocabulary.encode(batch)

    pieces = F.regexp_extract_all(whole_text(text), F.lit(java_pattern(pattern)), F.lit(0))
    return docs.withColumn(column, look_up(pieces))


def decode(docs: DataFrame, ranks: dict[bytes, int], ids: str = "token_ids", column: str = "decoded") -> DataFrame:
    """``docs`` with a binary column: the concatenated pieces of the ids. Null ids give null; unknown ids are an error."""
    known = docs.sparkSession.sparkContext.broadcast((uuid.uuid4().hex, {v: k for k, v in ranks.items()}))

    @F.arrow_udf("binary")
    def joined(batch: pa.Array) -> pa.Array:
        return concatenated(batch, pieces_of(known))

    return docs.withColumn(column, joined(F.col(ids)))


_PIECES: dict[str, pa.Array] = {}


def pieces_of(known: Broadcast) -> pa.Array:
    """The piece of each id, null where there is none; built once in a worker."""
    key, table = known.value
    if key not in _PIECES:
        _PIECES.clear()
        _PIECES[key] = pa.array([table.get(i) for i in range(max(table) + 1)], pa.binary())
    return _PIECES[key]


def concatenated(rows: pa.ListArray, pieces: pa.Array) -> pa.Array:
    """The pieces of each row's ids, one after another: they are taken into one buffer, of which each row is a slice."""
    bounds = rows.offsets.to_numpy()
    taken = pieces.take(rows.values.slice(bounds[0], bounds[-1] - bounds[0]))
    if taken.null_count:
        raise ValueError("an id without a piece")
    _, ends, content = taken.buffers()
    ends = np.frombuffer(ends, np.int32)[taken.offset :] if ends is not None and len(taken) else np.zeros(1, np.int32)
    offsets = pa.py_buffer(np.ascontiguousarray(ends[bounds - bounds[0]]))
    missing = rows.is_null()
    valid = pa.array(~missing.to_numpy(zero_copy_only=False)).buffers()[1] if rows.null_count else None
    return pa.Array.from_buffers(pa.binary(), len(rows), [valid, offsets, content or pa.py_buffer(b"")])


def ids_digest(ids: Column) -> Column:
    """Lower-case hex SHA-256 of ids as little-endian unsigned 32-bit integers."""

    @F.arrow_udf("string")
    def digest(batch: pa.Array) -> pa.Array:
        bounds = batch.offsets.to_numpy().tolist()
        values = memoryview(batch.values.to_numpy(zero_copy_only=False).astype("<u4"))
        return pa.array([hashlib.sha256(values[a:b]).hexdigest() for a, b in zip(bounds, bounds[1:])], pa.string())

    return digest(ids)
