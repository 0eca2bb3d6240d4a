"""Best-fit packing of token pieces, after Martello-Toth dominance reduction.

Every document is its token ids plus an end id; longer ones are cut into pieces of ``capacity`` ids, the
first piece taking the remainder. Pieces of one length are interchangeable, so the packing problem is
the histogram of piece lengths: at most ``capacity`` counts, whatever the corpus size. On that histogram
the reduction fixes the sets that provably dominate every alternative for their item (an item that
nothing joins, a pair that fills the sequence, a best partner where no two or three others can do
better), and run-length best-fit decreasing packs the rest. The plan, some thousands of intervals of
ranks per length, then joins the ranked pieces; ranks are salted running totals, so that a hot length
is spread over tasks.

Nulls and odd input: a null or empty text is its end id alone; rows with equal or null doc_id are
separate documents; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import json
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from photonlake.llm.common import materialize, square_buckets, with_running_total

PIECE_SCHEMA = "doc_id long, piece int, start long, length long, ids_crc32 long"


def _byte_letters() -> dict[str, int]:
    """The printable stand-ins of byte-level vocabularies: visible bytes are themselves, others follow from U+0100."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


def _ids_follow_merges(model: dict, letters: dict[str, int]) -> bool:
    """Whether single bytes have the lowest ids and every merge, in order, makes the next piece up, each piece by one merge."""
    vocab = model["vocab"]
    made = ["".join(m.split(" ") if isinstance(m, str) else m) for m in model["merges"]]
    ids = [vocab.get(x, -1) for x in made]
    singles = [vocab.get(c, -1) for c in letters]
    return min(singles) >= 0 and all(a < b for a, b in zip([max(singles), *ids], ids, strict=False)) and len(vocab) - len(made) - len(singles) <= len(model.get("special", [])) + 64


@lru_cache(maxsize=2)
def encoder(path: str):
    """text -> uint32 ids, as the tokenizer file gives them without added special tokens.

    Where the ids of the vocabulary rise as the file's merges follow one another, they are the merge ranks, and the faster of
    the two installed BPE engines runs them; any other file, and a text that holds the string of a special token, goes
    through the file's own library."""
    import tiktoken
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(path)
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    added = [t["content"] for t in spec.get("added_tokens", [])]

    def by_file(text: str) -> np.ndarray:
        return np.array(whole.encode(text, add_special_tokens=False).ids, dtype="<u4")

    pre = spec.get("pre_tokenizer") or {}
    model = spec["model"]
    odd = [pre.get("add_prefix_space"), not pre.get("use_regex", True), spec.get("normalizer"), *(model.get(k) for k in ("dropout", "ignore_merges", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback"))]
    letters = _byte_letters()
    if model.get("type") != "BPE" or pre.get("type") != "ByteLevel" or any(odd) or not _ids_follow_merges(model, letters):
        return by_file
    ranks = {bytes(letters[c] for c in piece): i for piece, i in model["vocab"].items() if piece not in added}
    pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
    fast = tiktoken.Encoding("file", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def encode(text: str) -> np.ndarray:
        if any(s in text for s in added):
            return by_file(text)
        return np.asarray(fast.encode_to_numpy(text, disallowed_special=()), dtype="<u4")

    return encode


def cut_pieces(docs: DataFrame, tokenizer_path: str, capacity: int, end_id: int, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32 (and the ids, when asked for)."""
    tail = pa.array([end_id], pa.uint32()).to_numpy()

    def run(batches):
        encode = encoder(tokenizer_path)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                out: dict[str, list] = {k: [] for k in ("doc_id", "piece", "start", "length", "ids_crc32", *(["ids"] if with_ids else []))}
                for doc, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    ids = np.concatenate([encode(text or ""), tail]).astype("<u4")
                    cuts = [0, *range((len(ids) - 1) % capacity + 1, len(ids) + 1, capacity)]
                    for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
                        out["doc_id"].append(doc)
                        out["piece"].append(k)
                        out["start"].append(a)
                        out["length"].append(b - a)
                        out["ids_crc32"].append(zlib.crc32(ids[a:b].tobytes()))
                        if with_ids:
                            out["ids"].append(ids[a:b].tolist())
                kinds = {"piece": pa.int32(), "ids": pa.list_(pa.int64())}
                yield pa.RecordBatch.from_arrays([pa.array(v, kinds.get(k, pa.int64())) for k, v in out.items()], list(out))

    return docs.select(F.col(id_col).cast("long"), text_col).mapInArrow(run, PIECE_SCHEMA + (", ids array<long>" if with_ids else ""))


def reduce_dominated(counts: np.ndarray, capacity: int) -> list[tuple[tuple[tuple[int, int], ...], int]]:
    """Take dominating sets out of ``counts`` (counts[n]: items of size n) and return them as (pattern, sequences)."""
    fixed = []

    def smallest(k: int) -> list[int]:
        found = []
        for n in np.flatnonzero(counts[: capacity + 1])[:k]:
            found += [int(n)] * int(min(k - len(found), counts[n]))
        return found[:k]

    def better_pair(best: int, room: int) -> bool:
        """Is there a pair of items whose sum is over ``best`` and fits ``room``?"""
        sizes = np.flatnonzero(counts[: room + 1])
        at = 0
        for a in sizes:
            rest = sizes[at:] if counts[a] > 1 else sizes[at + 1 :]
            at += 1
            low, high = np.searchsorted(rest, [best - a + 1, room - a + 1])
            if high > low:
                return True
        return False

    changed = True
    while changed:
        changed = False
        for j in range(capacity, 0, -1):
            while counts[j] > 0:
                counts[j] -= 1
                room = capacity - j
                fitting = np.flatnonzero(counts[: room + 1])
                if not len(fitting):
                    n, pattern = int(counts[j]) + 1, ((j, 1),)
                    counts[j] = 0
                    fixed.append((pattern, n))
                    changed = True
                    continue
                k = int(fitting[-1])
                low = smallest(3)
                dominates = k == room or sum(low[:2]) > room or len(low) < 2 or (sum(low) > room or len(low) < 3) and not better_pair(k, room)
                if not dominates:
                    counts[j] += 1
                    break
                if k == j:
                    n = (int(counts[j]) + 1) // 2
                    counts[j] += 1 - 2 * n
                    fixed.append((((j, 2),), n))
                else:
                    n = min(int(counts[j]) + 1, int(counts[k]))
                    counts[j] += 1 - n
                    counts[k] -= n
                    fixed.append((((j, 1), (k, 1)), n))
                changed = True
    return fixed


def best_fit(counts: np.ndarray, capacity: int) -> list[tuple[tuple[tuple[int, int], ...], int]]:
    """Best-fit decreasing in runs: equal items go together into equal open sequences."""
    open_: dict[int, list] = {}
    for size in range(capacity, 0, -1):
        n = int(counts[size])
        while n:
            room = min((r for r, groups in open_.items() if groups and r >= size), default=0)
            if room:
                pattern, m = open_[room].pop()
            else:
                room, pattern = capacity, ()
                m = -(-n // (capacity // size))
            each = room // size
            full = min(m, n // each)
            if full:
                open_.setdefault(room - each * size, []).append(((*pattern, (size, each)), full))
            n -= full * each
            m -= full
            if n and m:
                open_.setdefault(room - n * size, []).append(((*pattern, (size, n)), 1))
                n, m = 0, m - 1
            if m:
                open_.setdefault(room, []).append((pattern, m))
    return [group for groups in open_.values() for group in groups if group[0]]


def plan(histogram: dict[int, int], capacity: int) -> list[tuple[tuple[tuple[int, int], ...], int]]:
    """Patterns of (size, how often) with the number of sequences that follow each."""
    counts = np.zeros(capacity + 1, dtype=np.int64)
    for size, n in histogram.items():
        counts[size] = n
    fixed = reduce_dominated(counts, capacity)
    return fixed + best_fit(counts, capacity)


def intervals(patterns, capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """(length, low rank, high rank, first sequence, items a sequence, offset) for every part of every pattern."""
    cursor, rows, sequence = [0] * (capacity + 1), [], 0
    for pattern, n in patterns:
        offset = 0
        for size, times in pattern:
            rows.append((size, cursor[size], cursor[size] + n * times, sequence, times, offset))
            cursor[size] += n * times
            offset += size * times
        sequence += n
    return rows


def assign(pieces: DataFrame, capacity: int) -> DataFrame:
    """Add sequence_id and offset to pieces (which should be a written table: they are read twice)."""
    spark = pieces.sparkSession
    # One row per length that occurs: at most ``capacity`` rows reach the driver.
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    rows = intervals(plan(histogram, capacity), capacity)
    # A length meets an open group once per step of the best fit, and both are bounded by the capacity.
    table = spark.createDataFrame(rows, "length long, _low long, _high long, _first long, _times long, _at long")
    n = square_buckets(sum(histogram.values()))
    keyed = pieces.withColumn("_bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(n))).withColumn("_one", F.lit(1))
    ranked = with_running_total(keyed, ["length"], "_bucket", ["doc_id", "piece", "ids_crc32"], "_one")
    placed = ranked.join(F.broadcast(table), "length").filter("run_start >= _low and run_start < _high")
    inside = F.col("run_start") - F.col("_low")
    return (
        placed.withColumn("sequence_id", (F.col("_first") + F.floor(inside / F.col("_times"))).cast("long"))
        .withColumn("offset", (F.col("_at") + inside % F.col("_times") * F.col("length")).cast("long"))
        .drop("_bucket", "_one", "run_start", "seq", "_low", "_high", "_first", "_times", "_at")
    )


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = 1024, end_id: int = 2, with_ids: bool = False) -> DataFrame:
    """Pieces with their sequence and place."""
    return assign(materialize(cut_pieces(docs, tokenizer_path, capacity, end_id, with_ids=with_ids), "pack-pieces"), capacity)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return pack(docs, default_tokenizer()).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
