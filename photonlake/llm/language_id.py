"""Language ID: multinomial naive Bayes over hashed character n-grams.

Texts are folded to lower-case letters with single gaps; the n-grams of one to ``max_n`` characters are hashed
into 2^``bits`` columns. Fitting sums counts per language on a bounded sample of labelled documents; the log
probabilities, languages x 2^bits floats, are broadcast and batches are scored in numpy from sparse counts.

Nulls and odd input: a null text, or one without letters, is ``und`` with score 0; documents without a language,
or held out, teach nothing; a null doc_id is not held out and teaches nothing; with no language to learn every
text is ``und``; rows with equal doc_id are separate; an empty table gives an empty result; other columns pass by.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from photonlake.llm.common import mix64, text_buffers, text_slices

#: Documents per language that the fit reads at most: the bound of its sample.
SAMPLE_PER_LANGUAGE = 1000


@lru_cache(maxsize=1)
def folding() -> np.ndarray:
    """Code point -> its lower-case letter, or 0x20 for what is no letter."""
    table = np.full(0x110000, 0x20, dtype=np.uint32)
    for c in range(0x110000):
        ch = chr(c)
        if ch.isalpha():
            low = ch.lower()
            table[c] = ord(low) if len(low) == 1 else c
    return table


def char_grams(column: pa.Array, bits: int, max_n: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, hashed column) of every n-gram of a batch; a row without letters has none."""
    raw, offsets = text_buffers(column)
    if not len(raw):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    codes = folding()[np.frombuffer(raw.tobytes().decode().encode("utf-32-le"), dtype=np.uint32)]
    chars = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])[offsets]
    rows = np.repeat(np.arange(len(offsets) - 1), np.diff(chars))
    # Runs of blanks shrink to one, which also stands before the first letter of a row.
    blank = codes == 0x20
    again = blank.copy()
    again[1:] &= blank[:-1] & (rows[1:] == rows[:-1])
    again[0] = False
    codes, rows = codes[~again].astype(np.uint64), rows[~again]
    lettered = np.zeros(len(offsets) - 1, dtype=bool)
    lettered[rows[codes != 0x20]] = True
    use = lettered[rows]
    codes, rows = codes[use], rows[use]
    out_rows, out_cols = [], []
    key = np.zeros(len(codes), dtype=np.uint64)
    for n in range(1, max_n + 1):
        if len(codes) < n:
            break
        key = key[: len(codes) - n + 1] * np.uint64(0x110001) + codes[n - 1 :]
        same = rows[: len(codes) - n + 1] == rows[n - 1 :]
        wordy = same & (codes[: len(codes) - n + 1] != 0x20) if n == 1 else same
        hashed = mix64(key + np.uint64(n * 0x9E3779B97F4A7C15 % (1 << 64))) >> np.uint64(64 - bits)
        out_rows.append(rows[: len(codes) - n + 1][wordy])
        out_cols.append(hashed[wordy].astype(np.int64))
    return np.concatenate(out_rows), np.concatenate(out_cols)


def held_out(id_col: str):
    """crc32 of the id as text, modulo 5, is 0."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit(docs: DataFrame, id_col: str, text_col: str, lang_col: str, bits: int, max_n: int, sample: int, alpha: float = 0.5):
    """(languages, log probabilities of the grams); the priors are uniform, as the sample has as many of each."""
    learn = docs.filter(F.col(lang_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(id_col))
    # The bounded sample: per language the first documents by hash, cut within hash ranges before the last cut,
    # so that no task ranks a whole language (Spark cuts a rank filter of up to 1000 before its shuffle). Rows equal in
    # id and text are one document.
    mark = F.xxhash64(F.col(id_col).cast("string"), F.coalesce(F.col(text_col), F.lit("")), F.lit(3))
    ids = learn.select(F.col(lang_col).alias("_lang"), mark.alias("_mark")).distinct().withColumn("_part", F.pmod("_mark", F.lit(64)))
    ids = ids.withColumn("_n", F.row_number().over(W.partitionBy("_lang", "_part").orderBy("_mark"))).filter(F.col("_n") <= sample)
    ids = ids.withColumn("_n", F.row_number().over(W.partitionBy("_lang").orderBy("_mark"))).filter(F.col("_n") <= sample)
    # The last mark of each language's sample, a row a language, stands for the ids: no join has to move texts.
    cuts = {r["_lang"]: r["cut"] for r in ids.groupBy("_lang").agg(F.max("_mark").alias("cut")).collect()}
    table = F.create_map(*[F.lit(x) for pair in cuts.items() for x in pair]) if cuts else F.lit(None).cast("map<string,bigint>")
    chosen = learn.filter(mark <= F.element_at(table, F.col(lang_col))).groupBy(F.col(lang_col).alias("lang"), mark.alias("_mark")).agg(F.first(text_col).alias("text")).select("lang", "text")
    width = 1 << bits

    def run(batches):
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            for part in text_slices(batch, 1):
                rows, cols = char_grams(part.column(1), bits, max_n)
                langs = part.column(0).to_pylist()
                for lang in set(langs):
                    of = np.array([x == lang for x in langs])
                    total[lang] = total.get(lang, 0) + np.bincount(cols[of[rows]], minlength=width)
        for lang, counts in total.items():
            at = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array([lang]), pa.array([at.tolist()], pa.list_(pa.int32())), pa.array([counts[at].tolist()], pa.list_(pa.int64()))], ["lang", "at", "n"])

    sums = chosen.repartition(8).mapInArrow(run, "lang string, at array<int>, n array<long>")
    grams = sums.select("lang", F.explode(F.arrays_zip("at", "n")).alias("x")).groupBy("lang", "x.at").agg(F.sum("x.n").alias("n"))
    packed = grams.groupBy("lang", F.pmod("at", F.lit(16)).alias("p")).agg(F.collect_list("at").alias("at"), F.collect_list("n").alias("n"))
    # Languages x 2^bits counts at most, from a bounded sample.
    counts: dict[str, np.ndarray] = {}
    for r in packed.collect():
        counts.setdefault(r["lang"], np.zeros(width))[r["at"]] = r["n"]
    langs = sorted(counts)
    table = np.stack([counts[x] for x in langs]) + alpha if langs else np.zeros((0, width))
    return langs, np.log(table / table.sum(axis=1, keepdims=True)).astype(np.float32) if langs else table


def predict(docs: DataFrame, model, bits: int, max_n: int, id_col: str, text_col: str) -> DataFrame:
    langs, logp = model
    shared = docs.sparkSession.sparkContext.broadcast(np.ascontiguousarray(logp.T))

    def run(batches):
        matrix = shared.value
        for batch in batches:
            for part in text_slices(batch, 2):
                n = part.num_rows
                best, score = np.zeros(n, dtype=int), np.zeros(n)
                rows, cols = char_grams(part.column(2), bits, max_n)
                some = np.bincount(rows, minlength=n) > 0 if langs else np.zeros(n, dtype=bool)
                if langs and len(rows):
                    total = np.stack([np.bincount(rows, weights=matrix[cols, k], minlength=n) for k in range(len(langs))], axis=1)
                    odds = np.exp(total - total.max(axis=1, keepdims=True))
                    best, score = total.argmax(axis=1), (odds / odds.sum(axis=1, keepdims=True)).max(axis=1)
                names = [langs[b] if s else "und" for b, s in zip(best, some, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(names, pa.string()), pa.array(np.where(some, score, 0.0))], ["doc_id", "held_out", "lang_pred", "score"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out(id_col).alias("held_out"), text_col).mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", bits: int = 16, max_n: int = 3, sample: int = SAMPLE_PER_LANGUAGE) -> DataFrame:
    """Fit on the documents that are not held out, predict all."""
    return predict(docs, fit(docs, id_col, text_col, lang_col, bits, max_n, sample), bits, max_n, id_col, text_col)


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang"))
