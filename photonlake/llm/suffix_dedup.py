"""Suffix-array dedup: every byte of a ``length``-byte string that also starts earlier is found and removed.

Repeated strings are found by column-wise construction over many short strings at once: round by round one symbol is
put before every string of a collection, the Burrows-Wheeler segment of the round is the next column's symbols in
suffix order, sorting it stably gives the new order, and common prefixes are updated by range minima between
neighbours; order and prefixes are the only state. Neighbours with a common prefix of at least ``length`` are equal
strings. The external files are the sorted ones of the shuffle that deals strings out: a task streams them, one
collection of bounded size after another, and holds only that one.

Running that over whole documents would take a round per byte of the longest one on a single collection. So the
collection is dealt out first, without losing a string: every window of ``length`` bytes names the ``GRAM``-byte gram in it
with the least hash (leftmost on ties), so equal windows name equal grams. Marks of the grams are dealt out by gram
once and streamed in order: grams found once hold no repeat. The
stretch of windows around a gram that equals an earlier stretch is removed whole; of the different
stretches around a gram, the first of each are cut into spans of ``SPAN`` window starts, dealt out by the bytes
that all windows of a span share, and these strings are the collections above. Grams and stretches are compared by
64 and 128 bits of hash, the windows of collections byte by byte.

Nulls and odd input: a null text is empty; texts below ``length`` bytes keep all; null doc_ids come after every other
id; rows equal in doc_id and text are one document and lose the same bytes; different texts that share a doc_id (or have
none) are documents of their own, one after another by their hash; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from photonlake.llm.common import BASE, BASE_INVERSE, materialize, mix64, powers, release, text_buffers, text_slices

LENGTH, GRAM, SPAN = 100, 32, 16
#: A stretch is (gram start, windows before it) in one number, so that rows in flight stay small.
ROOM = 10
#: Strings that are laid out at once: places take eight times their bytes.
SLAB = 4096
LAST_ID = (1 << 63) - 1


class Prefix:
    """Hashes of any stretch of a buffer from one prefix polynomial."""

    def __init__(self, raw: np.ndarray):
        n = len(raw)
        self.sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * powers(BASE, n), dtype=np.uint64, out=self.sums[1:])
        self.back = powers(BASE_INVERSE, n + 1)

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix64((self.sums[end] - self.sums[start]) * self.back[start])


def anchors(raw: np.ndarray, offsets: np.ndarray, length: int, gram: int):
    """(gram hash, stretch hash, row, gram start, first window, last window) of every stretch; offsets are in the row."""
    n, w = len(raw), length - gram + 1
    if n < length:
        return [np.zeros(0, np.uint64)] * 2 + [np.zeros(0, np.int64)] * 4
    prefix = Prefix(raw)
    at = np.arange(n - gram + 1)
    grams = mix64((prefix.sums[gram:] - prefix.sums[:-gram]) * prefix.back[: n - gram + 1])
    bits = np.uint64(n.bit_length())
    least = (grams >> bits << bits) | at.astype(np.uint64)
    size = 1
    while size * 2 <= w:
        least = np.minimum(least[:-size], least[size:])
        size *= 2
    if size < w:
        least = np.minimum(least[: len(least) - (w - size)], least[w - size :])
    place = (least & np.uint64((1 << int(bits)) - 1)).astype(np.int64)
    # Windows lie inside a row: those that cross its end are no windows.
    inside = np.zeros(len(place) + 1, dtype=np.int64)
    room = np.diff(offsets) >= length
    np.add.at(inside, offsets[:-1][room], 1)
    np.add.at(inside, offsets[1:][room] - length + 1, -1)
    good = np.cumsum(inside)[:-1] > 0
    head = good.copy()
    head[1:] &= ~good[:-1] | (place[1:] != place[:-1])
    # Rows that touch may follow one another without a gap only when their windows name different grams.
    first = np.flatnonzero(head)
    stop = good & np.append(~good[1:] | (place[1:] != place[:-1]), True)
    last = np.flatnonzero(stop)
    gram_at = place[first]
    row = np.searchsorted(offsets, first, side="right") - 1
    stretch = mix64(prefix(first, last + length) + mix64(((last - first) << 20 | (gram_at - first)).astype(np.uint64)))
    base = offsets[row]
    return grams[gram_at], stretch, row, gram_at - base, first - base, last - base


def equal_windows(groups: np.ndarray, columns: np.ndarray, length: int, starts: int):
    """Column-wise construction over strings of the rows of ``columns`` (symbol + 1, 0 where a string has none).

    groups must rise; only strings of one group are compared. Yields, for the first ``starts`` columns, (column,
    order, run): strings of equal run have equal windows of ``length`` symbols from that column on."""
    n, width = columns.shape
    order, common = np.arange(n), np.zeros(n + 1, dtype=np.int32)
    for j, column in ((j, columns[:, j]) for j in range(width - 1, -1, -1)):
        bwt = column[order].astype(np.int64)
        key = groups[order] << np.int64(9) | bwt
        perm = np.argsort(key, kind="stable")
        joined = np.flatnonzero((key[perm][1:] == key[perm][:-1]) & (bwt[perm][1:] > 0)) + 1
        fresh = np.zeros(n + 1, dtype=np.int32)
        if len(joined):
            between = np.stack([perm[joined - 1] + 1, perm[joined] + 1], axis=1).reshape(-1)
            fresh[joined] = 1 + np.minimum.reduceat(common, between)[::2]
        order, common = order[perm], fresh
        if j < starts:
            yield j, order, np.cumsum(common[:n] < length)


def later_windows(key, lead, strings, docs, at, length: int, span: int):
    """(string, window start) of windows that also start earlier, for strings sorted by key; lead: first column of each,
    docs: numbers that rise as the documents do."""
    size = np.array([len(s) for s in strings])
    width = span - 1 + length
    columns = np.zeros((len(strings), width), dtype=np.uint16, order="F")
    for k in range(0, len(strings), SLAB):
        flat, n = np.frombuffer(b"".join(strings[k : k + SLAB]), dtype=np.uint8), size[k : k + SLAB]
        row = np.repeat(np.arange(k, k + len(n)), n)
        columns[row, np.arange(len(flat)) - np.repeat(np.cumsum(n) - n, n) + lead[row]] = flat.astype(np.uint16) + 1
    groups = np.cumsum(np.concatenate([[0], key[1:] != key[:-1]])).astype(np.int64)
    who, where = [], []
    for j, order, run in equal_windows(groups, columns, length, span):
        start = at[order] + (j - lead[order])
        rank = np.lexsort((start, docs[order], run))
        run_, doc_, start_, order_ = run[rank], docs[order][rank], start[rank], order[rank]
        begin = np.flatnonzero(np.concatenate([[True], run_[1:] != run_[:-1]]))
        of = np.repeat(begin, np.diff(np.append(begin, len(run_))))
        later = (doc_ != doc_[of]) | (start_ != start_[of])
        who.append(order_[later])
        where.append(start_[later])
    return np.concatenate(who), np.concatenate(where)


def repeated_marks(h, c, ids, subs, place):
    """(rows to keep, rows that are later for certain) of the marks of a few texts: of equal stretches the first is kept,
    others of other documents or places are later, and the rest are the first one's own."""
    order = np.argsort(h ^ mix64(c), kind="stable")
    same = np.append(False, (h[order][1:] == h[order][:-1]) & (c[order][1:] == c[order][:-1]))
    some = order[same | np.append(same[1:], False)]
    some = some[np.lexsort((place[some], subs[some], ids[some], c[some], h[some]))]
    keep = np.ones(len(h), dtype=bool)
    keep[some] = False
    if not len(some):
        return np.flatnonzero(keep), some
    head = np.append(True, (h[some][1:] != h[some][:-1]) | (c[some][1:] != c[some][:-1]))
    keep[some[head]] = True
    of = some[np.maximum.accumulate(np.where(head, np.arange(len(some)), 0))]
    return np.flatnonzero(keep), some[(ids[some] != ids[of]) | (subs[some] != subs[of]) | (place[some] != place[of])]


class Marks:
    """Marks (h, c, id, sub, place) sorted by all five, batch by batch; only the first of the current stretch is held.

    ``take`` gives the rows (h, id, sub, place, open): open are the first of each of several stretches around one gram,
    the others are stretches that also start earlier."""

    def __init__(self):
        self.held = np.zeros((5, 0), dtype=np.int64)
        self.told = False  # the held one has been given as open

    def take(self, rows: np.ndarray):
        carried = self.held.shape[1]
        rows = np.concatenate([self.held, rows], axis=1)
        n = rows.shape[1]
        if not n:
            return rows[[0, 2, 3, 4]], np.zeros(0, dtype=bool)
        head = np.append(True, (rows[:2, 1:] != rows[:2, :-1]).any(axis=0))
        of = np.maximum.accumulate(np.where(head, np.arange(n), 0))
        later = ~head & (rows[2:] != rows[2:, of]).any(axis=0)
        first = np.flatnonzero(head)
        beside = rows[0, first][1:] == rows[0, first][:-1]
        several = np.append(False, beside) | np.append(beside, False)
        told = bool(several[-1])
        if carried:
            told |= self.told and len(first) == 1
            several[0] &= not self.told
        self.held, self.told = rows[:, first[-1:]], told
        open_ = np.zeros(n, dtype=bool)
        open_[first[several]] = True
        pick = later | open_
        return rows[[0, 2, 3, 4]][:, pick], open_[pick]


def spans_of(docs: np.ndarray, starts: np.ndarray, length: int):
    """Windows as (document, from, to) with runs of successive starts joined."""
    order = np.lexsort((starts, docs))
    docs, starts = docs[order], starts[order]
    new = np.ones(len(docs), dtype=bool)
    new[1:] = (docs[1:] != docs[:-1]) | (starts[1:] > starts[:-1] + 1)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(docs)) - 1
    return docs[first], starts[first], starts[last] + length


def numbered(ids: np.ndarray, subs: np.ndarray):
    """Documents (id, sub) as numbers that rise with them, and the (id, sub) of each number."""
    every, docs = np.unique(np.stack([ids, subs], axis=1), axis=0, return_inverse=True)
    return docs.reshape(-1), every


SPANS = "id long, sub long, lo int, hi int"


def _span_batch(ids, subs, lo, hi) -> pa.RecordBatch:
    columns = [(ids, pa.int64()), (subs, pa.int64()), (lo, pa.int32()), (hi, pa.int32())]
    return pa.RecordBatch.from_arrays([pa.array(np.asarray(c), k) for c, k in columns], ["id", "sub", "lo", "hi"])


def identified(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, id, sub, text): rows equal in id and text are one document; texts that share an id go by their hash."""
    doc, text = F.col(id_col).cast("long"), F.col(text_col)
    return docs.select(doc.alias("doc_id"), F.coalesce(doc, F.lit(LAST_ID)).alias("id"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("sub"), text.alias("text"))


def repeated_spans(texts: DataFrame, length: int = LENGTH, gram: int = GRAM, span: int = SPAN) -> DataFrame:
    """texts (id, sub, text) -> (id, sub, spans): bytes (lo, hi) covered by windows that also start earlier; they may overlap."""

    def find(batches):
        for batch in batches:
            for part in text_slices(batch, 2, 1_000_000):
                ids, subs = part.column(0).to_numpy(), part.column(1).to_numpy()
                h, c, row, at, lo, hi = anchors(*text_buffers(part.column(2)), length, gram)
                place = at << 2 * ROOM | (at - lo) << ROOM | (at - hi)
                keep, later = repeated_marks(h, c, ids[row], subs[row], place)
                # What is later for certain needs no meeting: it is dealt out by a value of its own, so that the copies
                # of a frequent stretch reach its task as one mark for each run of texts.
                h = np.append(h[keep], mix64((ids[row[later]] ^ subs[row[later]] ^ place[later]).astype(np.uint64)))
                place = np.append(place[keep], -1 - place[later])
                of = np.append(keep, later)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (h.view(np.int64), c[of].view(np.int64), ids[row[of]], subs[row[of]], place)], ["h", "c", "id", "sub", "place"])

    def meet(batches):
        marks = Marks()
        for batch in batches:
            rows = np.stack([batch.column(k).to_numpy() for k in range(5)])
            known = rows[4] < 0
            (h, ids, subs, place), open_ = marks.take(rows[:, ~known])
            sure = rows[:, known]
            ids, subs, place = np.append(ids, sure[2]), np.append(subs, sure[3]), np.append(place, -1 - sure[4])
            h, whole = np.append(h, sure[0]), np.append(~open_, np.ones(sure.shape[1], dtype=bool))
            yield pa.RecordBatch.from_arrays([pa.array(h, mask=whole), pa.array(ids), pa.array(subs), pa.array(place)], ["h", "id", "sub", "place"])

    part = (1 << ROOM) - 1
    at = F.shiftright("place", 2 * ROOM)
    low, high = at - F.shiftright("place", ROOM).bitwiseAND(part), at - F.col("place").bitwiseAND(part)
    marks = texts.mapInArrow(find, "h long, c long, id long, sub long, place long")
    marks = marks.repartition("h").sortWithinPartitions("h", "c", "id", "sub", "place")
    # (h, id, sub, place): h is null where the whole stretch also starts earlier.
    found = materialize(marks.mapInArrow(meet, "h long, id long, sub long, place long"), "suffix-marks")
    whole = found.filter("h is null").select("id", "sub", low.cast("int").alias("lo"), (high + length).cast("int").alias("hi"))
    open_ = found.filter("h is not null").groupBy("id", "sub").agg(F.collect_list(F.struct("h", at.alias("at"), low.alias("lo"), high.alias("hi"))).alias("marks"))

    def cut(batches):
        for batch in batches:
            for part in text_slices(batch, 2, 1_000_000):
                raw, offsets = text_buffers(part.column(2))
                lists = part.column(3)
                marks_ = lists.flatten()
                h, at, lo, hi = (marks_.field(k).to_numpy(zero_copy_only=False) for k in ("h", "at", "lo", "hi"))
                row = np.repeat(np.arange(part.num_rows), np.diff(lists.offsets.to_numpy()))
                ids, subs, base = part.column(0).to_numpy()[row], part.column(1).to_numpy()[row], offsets[row]
                if not len(h):
                    continue
                low, high = (at - hi) // span, (at - lo) // span
                times = high - low + 1
                of = np.repeat(np.arange(len(h)), times)
                k = np.arange(len(of)) - np.repeat(np.cumsum(times) - times, times) + low[of]
                top = at[of] - k * span  # last nominal window start of the span; its first is span - 1 before
                first, last = np.maximum(top - span + 1, lo[of]), np.minimum(top, hi[of])
                prefix = Prefix(raw)
                core = prefix(base[of] + top, base[of] + top - span + 1 + length)
                key = mix64(core ^ mix64(h.view(np.uint64)[of] + k.astype(np.uint64) * BASE)).view(np.int64)
                a, b = base[of] + first, base[of] + last + length
                data = raw.tobytes()
                strings = pa.array([data[x:y] for x, y in zip(a.tolist(), b.tolist(), strict=True)], pa.binary())
                lead = (first - (top - span + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(lead), strings, pa.array(ids[of]), pa.array(subs[of]), pa.array(first.astype(np.int32))], ["key", "lead", "string", "id", "sub", "at"])

    strings = texts.join(open_, ["id", "sub"]).select("id", "sub", "text", "marks").mapInArrow(cut, "key long, lead int, string binary, id long, sub long, at int")

    def build(batches):
        held: list[pa.Table] = []

        def settle(table: pa.Table):
            key, lead, ids, subs, at = (table.column(c).to_numpy() for c in ("key", "lead", "id", "sub", "at"))
            twins = np.zeros(len(key), dtype=bool)
            twins[1:] |= key[1:] == key[:-1]
            twins[:-1] |= key[1:] == key[:-1]
            if twins.any():
                got = table.column("string").combine_chunks().filter(pa.array(twins)).to_pylist()
                pick = np.flatnonzero(twins)
                docs, every = numbered(ids[pick], subs[pick])
                who, where = later_windows(key[pick], lead[pick].astype(np.int64), got, docs, at[pick].astype(np.int64), length, span)
                if len(who):
                    doc, lo, hi = spans_of(docs[who], where, length)
                    yield _span_batch(every[doc, 0], every[doc, 1], lo, hi)

        before = None
        for batch in batches:
            if not batch.num_rows:
                continue
            # Equal strings of a key follow one another, the earliest first: the others are wholly repeated.
            key, lead, ids, subs, at = (batch.column(i).to_numpy() for i in (0, 1, 3, 4, 5))
            text = batch.column(2).to_pylist()
            rows = list(zip(key.tolist(), lead.tolist(), text, strict=True))
            same = np.array([r == p for r, p in zip(rows, [before, *rows[:-1]], strict=True)])
            if same.any():
                head = np.maximum.accumulate(np.where(same, -1, np.arange(len(rows))))
                last = {c: held[-1].column(c)[-1].as_py() if held else 0 for c in ("id", "sub", "at")}
                first = {c: np.where(head >= 0, v[head], last[c]) for c, v in (("id", ids), ("sub", subs), ("at", at))}
                later = same & ((ids != first["id"]) | (subs != first["sub"]) | (at != first["at"]))
                size = np.array([len(t) for t in text])
                yield _span_batch(ids[later], subs[later], at[later], (at + size)[later])
            before = rows[-1]
            held.append(pa.Table.from_batches([batch.filter(pa.array(~same))]))
            held = [t for t in held if t.num_rows] or held[-1:]
            if sum(t.num_rows for t in held) > 60_000:
                table = pa.concat_tables(held).combine_chunks()
                keys = table.column("key").to_numpy()
                done = int(np.searchsorted(keys == keys[-1], True))
                if done:
                    yield from settle(table.slice(0, done))
                held = [table.slice(done)]
        if held:
            yield from settle(pa.concat_tables(held).combine_chunks())

    dealt = strings.repartition("key").sortWithinPartitions("key", "lead", "string", "id", "sub", "at")
    every = whole.unionByName(dealt.mapInArrow(build, SPANS)).groupBy("id", "sub").agg(F.collect_list(F.struct("lo", "hi")).alias("spans"))
    spans = materialize(every, "suffix-spans")
    release(found)
    return spans


def remove_spans(docs: DataFrame, spans: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """docs' rows as (id, n_bytes, n_removed, spans, kept): maximal removed runs and the bytes that stay."""
    rows = identified(docs, id_col, text_col)

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                out = []
                for doc, text, found in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True):
                    data = (text or "").encode()
                    runs: list[list[int]] = []
                    for s in sorted((s["lo"], s["hi"]) for s in found or []):
                        lo, hi = s[0], min(s[1], len(data))
                        if lo >= hi:
                            continue
                        if runs and lo <= runs[-1][1]:
                            runs[-1][1] = max(runs[-1][1], hi)
                        else:
                            runs.append([lo, hi])
                    cuts = [0, *(x for r in runs for x in r), len(data)]
                    kept = b"".join(data[a:b] for a, b in zip(cuts[::2], cuts[1::2], strict=True))
                    out.append((doc, len(data), len(data) - len(kept), len(runs), hashlib.sha256(kept).hexdigest(), kept))
                kinds = [pa.int64()] * 4 + [pa.string(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    return rows.join(spans, ["id", "sub"], "left").select("doc_id", "text", "spans").mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")


def dedup_substrings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM, span: int = SPAN) -> DataFrame:
    """Each document without the bytes of strings that start earlier."""
    texts = identified(docs, id_col, text_col).drop("doc_id")
    return remove_spans(docs, repeated_spans(texts, length, gram, span), id_col, text_col)


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_substrings(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")).drop("kept")
