import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from photonlake.llm import language_id, license_scan, line_dedup, media, minhash, mixing, packing, quality, suffix_dedup, vector_dedup
from photonlake.llm.components import connected_components
from tests.llm import corpus

BLANK = " \t\n\x0b\x0c\r"


def unique_ids(spark, n=60):
    """The corpus without null and repeated ids, for comparisons row by row."""
    data = {r[0]: r for r in corpus.rows(n=n) if r[0] is not None}
    return list(data.values()), corpus.documents(spark, list(data.values()))


# line dedup


def brute_lines(data):
    holders = defaultdict(set)
    key = lambda line: "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(BLANK))
    for i, t, *_ in data:
        for line in (t or "").split("\n"):
            if len(key(line)) >= 10:
                holders[key(line)].add(i)
    out = {}
    for i, t, *_ in data:
        lines = (t or "").split("\n")
        kept = [x for x in lines if len(holders.get(key(x), ())) < 2 or min(holders[key(x)]) == i]
        out[i] = (len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest())
    return out


@pytest.mark.parametrize("batches", [1, 3, 5])
def test_line_dedup_matches_brute_force(spark, batches):
    data, docs = unique_ids(spark)
    got = line_dedup.dedup_lines(corpus.odd_columns(docs), n_batches=batches).select("doc_id", "_n_lines", "_n_dropped", F.sha2(F.col("_kept").cast("binary"), 256)).collect()
    assert {r[0]: tuple(r[1:]) for r in got} == brute_lines(data)
    assert sum(r[2] for r in got) > 5


def test_line_store_compacts_levels(spark):
    store = line_dedup.RunStore(spark, fanout=2)
    for i in range(4):
        store.add(spark.createDataFrame([(i, 1, 1), (i, 10 + i, 1)], "doc long, h1 long, h2 long"))
    assert [len(x) for x in store.levels] == [0, 0, 1]
    assert sorted((r.h1, r.owner) for run in store.runs() for r in run.collect()) == [(1, 0), (10, 0), (11, 1), (12, 2), (13, 3)]
    store.close()


def test_line_runs_are_merged_as_they_lie(spark):
    """No exchange and no sort above the scan of a run."""
    store = line_dedup.RunStore(spark)
    batch = spark.createDataFrame([(i, i % 3, i) for i in range(30)], "doc long, h1 long, h2 long")
    store.add(batch)
    with store._sorted_scans():
        plan = store.marked(batch)._jdf.queryExecution().executedPlan().toString().split("\n")
    scan = next(i for i, x in enumerate(plan) if "FileScan" in x and "Bucketed: true" in x)
    above = []
    depth = len(plan[scan])
    for x in reversed(plan[: scan + 1]):
        at = next(k for k, c in enumerate(x) if c.isalpha())
        if at < depth:
            above.append(x)
            depth = at
        if "SortMergeJoin" in x and at <= depth:
            break
    assert "SortMergeJoin" in above[-1] and not any("Exchange" in x or "Sort [" in x for x in above), "\n".join(plan)
    store.close()


def test_repeated_lines_of_long_texts_cost_in_proportion(spark):
    import time

    text = "\n".join(f"line {i} of a very long document" for i in range(100_000))
    same = "\n".join(["one and the same line"] * 100_000)
    data = [(1, text), (2, text), (3, same), (4, same), (None, text), (None, "line 7 of a very long document\nnew words")]
    docs = spark.createDataFrame([(i, t, "en", "a", 1) for i, t in data], corpus.SCHEMA)
    start = time.time()
    got = sorted((r.doc_id or 0, r._n_lines, r._n_dropped) for r in line_dedup.dedup_lines(docs).select("doc_id", "_n_lines", "_n_dropped").collect())
    assert got == [(0, 2, 1), (0, 100_000, 100_000), (1, 100_000, 0), (2, 100_000, 100_000), (3, 100_000, 0), (4, 100_000, 100_000)]
    assert time.time() - start < 60


# mixing


def test_mix_meets_targets_and_repeats_within_bounds(spark):
    docs = corpus.odd_columns(corpus.documents(spark))
    rows, pieces = mixing.mix(docs, block=64)
    got = rows.toPandas()
    assert len(got) == len(corpus.rows())
    assert (got.taken <= 3 * got["size"]).all()
    per = got.groupby("source_size").agg(t=("target", "first"), taken=("taken", "sum"))
    assert (abs(per.t - per.taken) <= 1).all()
    again = mixing.mix(docs, block=64)[0].toPandas()
    order = ["id", "size", "taken"]
    assert got[order].sort_values(order).reset_index(drop=True).equals(again[order].sort_values(order).reset_index(drop=True))
    p = pieces.toPandas()
    assert p.words.sum() == got.taken.sum() and (p.groupby("slot").words.sum() <= 64).all()


def test_mix_follows_its_schedule(spark):
    """Every row's first slot and words, and every slot's source, from a plain walk through the golden-ratio points."""
    data, docs = unique_ids(spark)
    block = 64
    rows, pieces = mixing.mix(docs, block=block)
    size = {r[0]: len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or "")) for r in data}
    sources = sorted({r[3] for r in data}, key=lambda x: (x is None, x or ""))
    target = {r.id: r.target for r in rows.collect()}
    take = {s: int(next(target[r[0]] for r in data if r[3] == s)) for s in sources}
    need = [-(-take[s] // block) for s in sources]
    edge = np.concatenate([[0], np.cumsum(need)]) * (2.0**40 / sum(need))
    slots = {s: [] for s in sources}
    for i in range(sum(need)):
        k = int(np.searchsorted(np.floor(edge), i * mixing.GOLDEN_STEP % 2**40, side="right")) - 1
        slots[sources[k]].append(i)
    for k, s in enumerate(sources):
        held = len(slots[s])
        slots[s] = slots[s][: need[k]] + [sum(need) + r * (1 << 20) + k + 1 for r in range(held, need[k])]
    first, words = {}, Counter()
    for s in sources:
        mine = sorted((r[0] for r in data if r[3] == s), key=lambda i: (hashlib.md5(str(i).encode()).hexdigest(), i))
        at = 0
        while at < take[s]:
            for i in mine:
                n = max(0, min(size[i], take[s] - at))
                if n:
                    first.setdefault(i, slots[s][at // block])
                words[i] += n
                at += n
    assert {r.id: (r.first_slot, r.taken) for r in rows.collect()} == {r[0]: (first.get(r[0]), words[r[0]]) for r in data}
    per_slot = pieces.groupBy("slot").agg(F.sum("words").alias("n")).collect()
    assert sum(r.n for r in per_slot) == sum(take.values())


def test_targets_stop_at_their_cap(spark):
    sizes = spark.createDataFrame([(False, "a", 1000), (False, "b", 10), (False, "c", 10)], "_no_source boolean, _source string, size long")
    got = {r._source: r.target for r in mixing.source_targets(sizes).collect()}
    assert got == {"a": 960.0, "b": 30.0, "c": 30.0}


def test_golden_points_are_low_discrepancy(spark):
    n = 2000
    p = np.sort([r[0] for r in spark.range(n).select(mixing.golden_point(F.col("id"))).collect()]) / 2**40
    assert abs(p - (np.arange(n) + 0.5) / n).max() < 5 / n


# packing


def test_pack_places_every_id_once(spark):
    from tokenizers import Tokenizer

    data, docs = unique_ids(spark)
    got = packing.pack(docs, packing.default_tokenizer(), capacity=256, with_ids=True).toPandas().sort_values(["doc_id", "piece"])
    tok = Tokenizer.from_file(packing.default_tokenizer())
    for i, t, *_ in data:
        ids = tok.encode(t or "", add_special_tokens=False).ids + [2]
        mine = got[got.doc_id == i]
        assert [x for part in mine.ids for x in part] == ids
        assert (mine.length.iloc[1:] == 256).all()
        assert [zlib.crc32(np.array(x, "<u4").tobytes()) for x in mine.ids] == mine.ids_crc32.tolist()
    seq = got.sort_values(["sequence_id", "offset"])
    for _, s in seq.groupby("sequence_id"):
        assert s.offset.tolist() == [0, *s.length.cumsum().tolist()[:-1]] and s.length.sum() <= 256


def test_special_strings_and_plain_texts_match_the_tokenizer():
    from tokenizers import Tokenizer

    path = packing.default_tokenizer()
    tok, encode = Tokenizer.from_file(path), packing.encoder(path)
    for t in ["", "a<|endoftext|>b", "  two  blanks \n\n", "don't WE'LL", "naïve – 漢字 🙂", "\u0000\u0001", "x" * 5000]:
        assert encode(t).tolist() == tok.encode(t, add_special_tokens=False).ids


def test_only_files_whose_ids_follow_their_merges_are_run_by_rank():
    letters = packing._byte_letters()
    vocab = {c: i for i, c in enumerate(letters)} | {"ab": 256, "abc": 257}
    model = {"vocab": vocab, "merges": ["a b", ["ab", "c"]]}
    assert packing._ids_follow_merges(model, letters)
    assert not packing._ids_follow_merges({"vocab": vocab | {"ab": 257, "abc": 256}, "merges": model["merges"]}, letters)
    assert not packing._ids_follow_merges({"vocab": {k: v for k, v in vocab.items() if k != "ab"}, "merges": model["merges"]}, letters)


def optimum(sizes, capacity):
    best = len(sizes)

    def go(i, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if i == len(sizes):
            best = len(bins)
            return
        for k in sorted(set(bins)):
            if k + sizes[i] <= capacity:
                rest = list(bins)
                rest.remove(k)
                go(i + 1, [*rest, k + sizes[i]])
        go(i + 1, [*bins, sizes[i]])

    go(0, [])
    return best


def test_reduction_keeps_the_optimum():
    rng = np.random.default_rng(3)
    for _ in range(60):
        sizes = sorted(rng.integers(1, 21, rng.integers(1, 10)).tolist(), reverse=True)
        counts = np.bincount(sizes, minlength=21)
        fixed = packing.reduce_dominated(counts, 20)
        left = [s for s in range(20, 0, -1) for _ in range(counts[s])]
        used = Counter(s for pattern, n in fixed for s, k in pattern for _ in range(n * k))
        assert used + Counter(left) == Counter(sizes)
        assert all(sum(s * k for s, k in p) <= 20 for p, _ in fixed)
        assert sum(n for _, n in fixed) + (optimum(left, 20) if left else 0) == optimum(sizes, 20)


# license scans


def test_licenses_match_brute_force(spark):
    texts = ["Released under the MIT License.", "the Apache-License, of\nMIT\nlicense", "Licensed under CC BY-NC 4.0.", None, "", "GENERAL public License general public license", "under the released mit", "This work is licensed under the GNU General Public License, version 3. " * 3]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in license_scan.scan_licenses(corpus.odd_columns(docs)).collect()}
    low = lambda t: "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
    sets = {k: set(v.split()) for k, v in license_scan.TEMPLATES.items()}
    for i, t in enumerate(texts):
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(t))
        places = [(a, label) for p, label in license_scan.PHRASES.items() for a in range(len(words)) if words[a : a + len(p.split())] == p.split()]
        hits = {label for line in (t or "").split("\n") for label, s in {k: {w for x in v for w in re.findall(r"[a-z0-9]+", x)} for k, v in sets.items()}.items() if len(s & set(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(line)))) >= 0.8 * len(s)}
        r = got[i]
        assert (r.n_words, r.n_base) == (len(words), len(places))
        assert r.first_word == min((a for a, _ in places), default=None) and r.last_word == max((a for a, _ in places), default=None)
        assert r.base_labels == ",".join(sorted({x for _, x in places})) and r.labels == ",".join(sorted({x for _, x in places} | hits))
        assert 0 <= r.score <= 1


@pytest.mark.parametrize("line, label", [
    ("All rights reserved.", "rights-reserved"),
    ("Copyright 2020 A. Body. All Rights Reserved.", "rights-reserved"),
    ("Licensed under CC BY-NC 4.0.", "cc-by-nc-4.0"),
    ("Released under the MIT License.", "mit-notice"),
    ("Licensed under the Apache License, Version 2.0.", "apache-2.0"),
    ("This work is licensed under the GNU General Public License, version 3.", "gpl-3"),
])
def test_every_notice_form_is_found(spark, line, label):
    docs = spark.createDataFrame([(1, f"Some text.\n{line}\nMore text.")], "doc_id long, text string")
    row = license_scan.scan_licenses(docs).first()
    assert label in row.labels.split(",") and row.score == 1.0 and row.blocks == [1]


def test_wrapped_notices_are_found(spark):
    notices = {
        "bsd-3": "Redistribution and use in source and binary forms, with or without\n# modification, are permitted",
        "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public\n * License, v. 2.0.",
        "gpl-2": "This program is free software; you can redistribute it and/or modify\nit under the terms of the GNU General Public License as published by\nthe Free Software Foundation; either version 2 of the License, or",
        "cc-by-4.0": "This work is licensed under a Creative\nCommons Attribution 4.0\n\nInternational License.",
        "rights-reserved": "Copyright A. Body. All rights\nreserved.",
    }
    far = "All of it.\n" + "Other words stand here. " * 20 + "\nThe rights.\n" + "Other words stand here. " * 20 + "\nIt is reserved."
    docs = spark.createDataFrame([*enumerate(f"Some text.\n{t}\nMore text." for t in notices.values()), (90, far)], "doc_id long, text string")
    got = {r.doc_id: r for r in license_scan.scan_licenses(docs).collect()}
    for i, (label, t) in enumerate(notices.items()):
        assert label in got[i].labels.split(",") and got[i].score == 1.0
        assert set(got[i].blocks) == set(range(1, t.count("\n") + 2))
    assert got[90].labels == "" and got[90].blocks == []


def test_runs_equal_all_windows():
    rng = np.random.default_rng(5)
    for _ in range(200):
        words = [f"w{i}" for i in rng.integers(0, 12, 40)]
        template, width = frozenset(f"w{i}" for i in range(6)), int(rng.integers(4, 12))
        best = max(len(template & set(words[i : i + width])) for i in range(len(words)))
        got = license_scan.run_hits(words, template, 4, width)
        assert max((n for n, _, _ in got), default=0) == (best if best >= 4 else 0)
        assert all(last - first < width and len(template & set(words[first : last + 1])) == n for n, first, last in got)


def test_prefix_join_equals_all_pairs():
    """Every filter prunes, and none loses a template."""
    rng = np.random.default_rng(0)
    vocabulary = [f"w{i}" for i in range(30)]
    templates = {f"t{k}": " ".join(rng.choice(vocabulary, rng.integers(2, 9), replace=False)) for k in range(12)}
    counts = {w: int(rng.integers(0, 50)) for w in vocabulary}
    index = license_scan.TemplateIndex(templates, counts, 0.7)
    tested = Counter()
    for _ in range(300):
        block = set(rng.choice(vocabulary, rng.integers(0, 20), replace=False))
        sets = license_scan.template_sets(templates)
        expected = {k: len(s & block) / len(s) for k, s in sets.items() if len(s & block) >= 0.7 * len(s) - 1e-9}
        assert index.match(block) == expected
        by_prefix = [k for k in sets if set(index.prefix(k)) & block]
        tested.update(pairs=len(sets), prefix=len(by_prefix), length=len(index.candidates(block, positional=False)), positional=len(index.candidates(block)), hits=len(expected))
        assert set(expected) <= set(index.candidates(block)) <= set(index.candidates(block, positional=False)) <= set(by_prefix)
    assert tested["pairs"] > tested["prefix"] > tested["length"] > tested["positional"] > tested["hits"]


def test_license_texts_match_all_windows(spark):
    """Whole and damaged license texts, wrapped at any column among other words, against every window of the text."""
    import random

    rng = random.Random(11)
    texts = []
    for label, template in license_scan.TEMPLATES.items():
        for share in (1.0, 0.9, 0.75, 0.5):
            words = [w for w in template.split() if rng.random() < share]
            words = corpus.prose(rng, 30).split() + words + corpus.prose(rng, 30).split()
            step = rng.randint(4, 12)
            texts.append("\n".join(("# " if rng.random() < 0.5 else "") + " ".join(words[i : i + step]) for i in range(0, len(words), step)))
    texts += [corpus.prose(rng, 200), None, "the of and " * 200]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in license_scan.scan_licenses(docs).collect()}
    sets = license_scan.template_sets(license_scan.TEMPLATES)
    found = 0
    for i, t in enumerate(texts):
        words = license_scan.words_of(t)
        best = {}
        for label, s in sets.items():
            width = 2 * len(license_scan.words_of(license_scan.TEMPLATES[label])) + license_scan.SLACK
            blocks = [set(words[k : k + width]) for k in range(max(1, len(words) - width + 1))] + [set(license_scan.words_of(x)) for x in (t or "").split("\n")]
            share = max(len(s & b) for b in blocks) / len(s)
            if share >= 0.8 - 1e-9:
                best[label] = share
        base = set(got[i].base_labels.split(",")) - {""}
        assert set(got[i].labels.split(",")) - {""} == set(best) | base, t
        assert abs(got[i].score - max([*best.values(), 1.0 if base else 0.0], default=0)) < 1e-9
        found += len(best)
    assert found > 2 * len(sets)


# media


def test_media_round_trip_and_equal_values(spark):
    docs = corpus.odd_columns(corpus.documents(spark))
    got = media.read_media(media.store_media(docs)).toPandas()
    texts = {r[0]: r[1] for r in corpus.rows() if r[0] is not None}
    for r in got[got.doc_id.notna()].itertuples():
        raw = (texts[r.doc_id] or "").encode()
        payload = raw + bytes((-len(raw)) % 64 or (64 if not raw else 0))
        assert (r.n_bytes, r.payload_bytes) == (len(raw), len(payload)) and r.payload_sha256 == hashlib.sha256(payload).hexdigest()
        assert r.tail_crc32 == zlib.crc32(payload[-64:]) and r.media_bytes == len(payload) + 44 and r.feature.startswith("wav:")


def tiny_png():
    chunk = lambda n, d: len(d).to_bytes(4, "big") + n + d + zlib.crc32(n + d).to_bytes(4, "big")
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", bytes(8) + b"\x08\0\0\0\0") + chunk(b"IDAT", zlib.compress(b"\0")) + chunk(b"IEND", b"")


def test_sniffing_confirms_corrects_and_carves():
    import gzip
    import io
    import zipfile

    png = tiny_png()
    z = io.BytesIO()
    with zipfile.ZipFile(z, "w") as f:
        f.writestr("a", "hello" * 20)
    gz = gzip.compress(b"data" * 30)
    assert media.sniff(png, "image/jpeg") == {"type": "png", "corrected": True, "length": len(png), "embedded": []}
    found = media.sniff(b"some text " + png + b" BM PK\x03\x04 no " + z.getvalue() + gz, None)
    assert found["embedded"] == [("png", 10, len(png)), ("zip", 10 + len(png) + 12, len(z.getvalue())), ("gzip", 10 + len(png) + 12 + len(z.getvalue()), len(gz))]
    broken = bytearray(png)
    broken[-6] ^= 1
    assert media.sniff(bytes(broken))["type"] is None
    assert media.sniff(media.to_wave(png + bytes(20)), "x")["embedded"] == [("png", 44, len(png))]


def test_later_end_marks_and_outer_archives_are_carved_whole():
    import io
    import time
    import zipfile

    def pdf(parts):
        out = b"%PDF-1.4\n"
        for k in range(parts):
            at = len(out)
            out += b"xref\n0 1\ntrailer 1 0 obj\nstartxref\n%d\n%%%%EOF" % at + (b"\n" if k + 1 < parts else b"")
        return out

    one, two = pdf(1), pdf(3)
    got = media.sniff(b"text " + two + b" more " + one + b" %PDF-1.7 alone", None)["embedded"]
    assert got == [("pdf", 5, len(two)), ("pdf", 5 + len(two) + 6, len(one))]
    inner, outer = io.BytesIO(), io.BytesIO()
    with zipfile.ZipFile(inner, "w") as z:
        z.writestr("a", "hello" * 30)
    with zipfile.ZipFile(outer, "w", zipfile.ZIP_STORED) as z:
        z.writestr("in.zip", inner.getvalue())
        z.writestr("b", "end")
    assert media.sniff(b"x" * 9 + outer.getvalue() + b"tail", None)["embedded"] == [("zip", 9, len(outer.getvalue()))]
    start = time.time()
    media.sniff(b"%PDF-1.4 obj PK\x03\x04 " * 100_000 + b"PK\x05\x06", None)
    assert time.time() - start < 20


# language


def test_language_matches_plain_naive_bayes(spark):
    """Counts, smoothing, softmax and held-out rows against loops over dictionaries."""
    rng = np.random.default_rng(8)
    words = {"en": ["the", "house", "with"], "de": ["das", "haus", "mit", "über"], "fr": ["le", "maison", "avec"]}
    data = [(i, " ".join(rng.choice(words[k], 12)), k) for i in range(60) for k in [["en", "de", "fr"][i % 3]]] + [(100, "the maison das", None), (7, "x y z", "en")]
    docs = spark.createDataFrame(data + data[:2], "doc_id long, text string, lang string")
    grams = lambda t: language_id.char_grams(pa.array([t]), 16, 3)[1].tolist()
    held = lambda i: zlib.crc32(str(i).encode()) % 5 == 0
    counts = defaultdict(Counter)
    for i, t, k in data:
        if k and not held(i):
            counts[k].update(grams(t))
    logs = {}
    for k, c in counts.items():
        total = sum(c.values()) + 0.5 * 2**16
        logs[k] = lambda g, c=c, total=total: np.log((c[g] + 0.5) / total)
    for r in language_id.identify(docs).collect():
        t = next(t for i, t, _ in data if i == r.doc_id and (i != 7 or grams(t)))
        if r.doc_id == 7:
            continue  # two texts share the id
        score = {k: sum(f(g) for g in grams(t)) for k, f in logs.items()}
        best = max(sorted(score), key=score.get)
        assert (r.lang_pred, r.held_out) == (best, held(r.doc_id))
        assert abs(r.score - 1 / sum(np.exp(v - score[best]) for v in score.values())) < 1e-3


def test_language_sample_is_bounded_for_repeated_rows(spark):
    data = [(1, f"the house {i % 3}", "en") for i in range(500)] + [(2, "das haus", "de")] * 50
    docs = spark.createDataFrame(data, "doc_id long, text string, lang string")
    assert {r.lang_pred for r in language_id.identify(docs, sample=2).collect()} == {"en", "de"}


def test_language_learns_and_names_undetermined(spark):
    rng = np.random.default_rng(5)
    words = {"en": ["the", "house", "with", "thing"], "de": ["das", "haus", "mit", "über", "schön"], "fr": ["le", "maison", "avec", "être"]}
    data = [(i, " ".join(rng.choice(words[k], 30)), k) for i in range(240) for k in [["en", "de", "fr"][i % 3]]] + [(900, None, "en"), (901, "", None), (902, "12 !? 34", "de"), (None, "the house", "fr"), (903, "das Haus", None)]
    docs = spark.createDataFrame(data, "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in language_id.identify(corpus.odd_columns(docs)).collect()}
    held = [d for d in data[:240] if zlib.crc32(str(d[0]).encode()) % 5 == 0]
    assert len(held) > 20 and all(got[i].lang_pred == k and got[i].held_out for i, _, k in held)
    assert [got[i].lang_pred for i in (900, 901, 902, 903)] == ["und", "und", "und", "de"] and got[None].held_out is False
    assert all(0 <= r.score <= 1 for r in got.values())


def test_language_without_anything_to_learn(spark):
    docs = spark.createDataFrame([(1, "words", None)], "doc_id long, text string, lang string")
    assert language_id.identify(docs).collect()[0].lang_pred == "und"


def test_char_grams_do_not_cross_rows():
    rows, cols = language_id.char_grams(pa.array(["ab", None, "Ab ", "a  b"]), 16, 3)
    of = lambda i: sorted(cols[rows == i].tolist())
    alone = [sorted(language_id.char_grams(pa.array([t]), 16, 3)[1].tolist()) for t in ("ab", "Ab ", "a  b")]
    assert [of(0), of(2), of(3)] == alone and not of(1)


# quality


def test_quality_orders_grades(spark):
    rng = np.random.default_rng(2)
    words = corpus.WORDS
    data, labels = [], []
    for i in range(400):
        kind = i % 4
        text = " ".join(rng.choice(words, 40))
        if kind == 0:
            text = " ".join(w + "***" for w in text.split())
        if kind == 1:
            text += " idiot scum"
        data.append((i, text))
        labels.append((i, int(kind != 0), int(kind == 1)))
    docs = spark.createDataFrame([*data, (900, None), (901, ""), (None, "x")], "doc_id long, text string")
    lab = spark.createDataFrame([(*x,) for x in labels[:300]] + [(950, None, 1)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in quality.classify(corpus.odd_columns(docs), lab).collect()}
    assert len(got) == 403
    new = range(300, 400)
    assert all(got[i]._kept for i in new if i % 4 > 1) and not any(got[i]._kept for i in new if i % 4 == 0)
    grades = [np.mean([got[i]._expected_grade for i in new if i % 4 == k]) for k in (0, 1, 2)]
    assert grades[0] < grades[1] < grades[2]
    assert all(0 <= b <= a <= 1 for a, b in (r._tails for r in got.values()))


def test_quality_rejects_held_out_toxic_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet").select("doc_id", "quality", "toxic")
    held = F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(5)) == 0
    new = labels.filter(held).withColumn("grade", quality.grade_of(labels)).filter("grade is not null").select("doc_id", "grade")
    scored = quality.classify(docs.join(labels.select("doc_id"), "doc_id", "left_semi"), labels.filter(~held))
    rates = {r.grade: r.kept for r in scored.join(new, "doc_id").groupBy("grade").agg(F.avg(F.col("_kept").cast("int")).alias("kept")).collect()}
    print(rates)
    assert rates[0] <= 0.02 and rates[1] <= 0.2 and rates[2] >= 0.98


def test_quality_with_one_grade_keeps_all(spark):
    docs = spark.createDataFrame([(1, "a"), (2, None)], "doc_id long, text string")
    lab = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    assert [(r._expected_grade, r._kept) for r in quality.classify(docs, lab).collect()] == [(2.0, True)] * 2


def test_classification_is_the_plain_formula(spark):
    """P(grade >= k) = sigmoid(score - threshold k) by loops, and a fit that no small step improves."""
    rng = np.random.default_rng(6)
    data = [(i, " ".join(rng.choice(corpus.WORDS, 20)) + (" idiot scum" if i % 3 == 1 else " ***" * (i % 3 == 0))) for i in range(120)]
    docs = spark.createDataFrame(data, "doc_id long, text string")
    lab = spark.createDataFrame([(i, int(i % 3 != 0), int(i % 3 == 1)) for i in range(120)], "doc_id long, quality int, toxic int")
    graded = lab.select(F.col("doc_id").alias("id"), quality.grade_of(lab).cast("int").alias("grade"))
    model = quality.fit_model(docs, graded, "doc_id", "text", 18, 8000)
    sigmoid = lambda z: 1 / (1 + np.exp(-z))
    for r in quality.classify(docs, lab).collect():
        rows, cols, vals = quality.features(pa.array([r.text]), 18)
        score = sum(float(np.float32(model.weights[c])) * v for c, v in zip(cols, vals, strict=True))
        tails = [sigmoid(score - t) for t in model.thresholds]
        assert np.allclose(r._tails, tails, atol=1e-6) and abs(r._expected_grade - sum(tails)) < 1e-6
        assert r._kept == (tails[1] >= quality.LEAST_TAIL)
    x, cols = np.repeat(np.arange(200), 3), rng.integers(0, 16, 600)
    y = np.digitize(np.bincount(x, weights=rng.normal(size=16)[cols]) + rng.logistic(size=200), [-1, 1])
    fit = quality.OrdinalModel.fit(x, cols, np.ones(600), y, 3, 4, epochs=2000, rate=0.02, penalty=1e-3)

    def loss(w, t):
        edges = np.concatenate([[-np.inf], t, [np.inf]])
        s = np.bincount(x, weights=w[cols], minlength=200)
        return -np.log(sigmoid(edges[y + 1] - s) - sigmoid(edges[y] - s)).mean() + 0.5e-3 * (w**2).sum()

    best = loss(fit.weights, fit.thresholds)
    for _ in range(100):
        assert loss(fit.weights + rng.normal(size=16) * 0.05, fit.thresholds + rng.normal(size=2) * 0.05) > best - 1e-6


def test_ordinal_gradient_descends():
    rng = np.random.default_rng(0)
    x = rng.integers(0, 64, 3000)
    rows = np.repeat(np.arange(600), 5)
    true = rng.normal(size=64)
    score = np.bincount(rows, weights=true[x])
    y = np.digitize(score, [-1, 1])
    m = quality.OrdinalModel.fit(rows, x, np.ones(3000), y, 3, 6)
    got = np.bincount(rows, weights=m.weights[x])
    assert (np.diff(m.thresholds) > 0).all() and np.corrcoef(got, score)[0, 1] > 0.95


# near duplicates


def weighted_classes(data, threshold=0.8):
    sets = {}
    for i, t, *_ in data:
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        sets[i] = Counter(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4)))
    parent = {i: i for i in sets}

    def find(u):
        while parent[u] != u:
            u = parent[u]
        return u

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sum((sets[a] & sets[b]).values()) >= threshold * sum((sets[a] | sets[b]).values()):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def family(rng, n=40):
    base = corpus.prose(rng, 150).split()
    out = []
    for k in range(n):
        w = list(base)
        for _ in range(k % 9):
            w[rng.randrange(len(w))] = f"new{rng.random()}"
        out.append(" ".join(w))
    return out


def test_minhash_classes_match_brute_force(spark):
    import random

    rng = random.Random(4)
    data, _ = unique_ids(spark, 40)
    data += [(1000 + i, t, "en", "a", 1) for i, t in enumerate(family(rng) + family(rng, 12))]
    docs = corpus.odd_columns(corpus.documents(spark, data))
    got = {r.id: r.class_id for r in minhash.classes(docs).collect()}
    assert got == weighted_classes(data)


def test_mixed_groups_are_tested_in_tiles(spark, monkeypatch):
    """Many components in one hub's group, cut into small tiles: the largest one is copied for the others only."""
    import random

    rng = random.Random(9)
    data = [(2000 + i, t, "en", "a", 1) for i, t in enumerate(family(rng, 90))]
    monkeypatch.setattr(minhash, "TILE", 6)
    got = {r.id: r.class_id for r in minhash.classes(corpus.documents(spark, data), bands=40, per_band=1).collect()}
    assert got == weighted_classes(data) and len(set(got.values())) > 1


def test_dart_signatures_estimate_weighted_similarity():
    rng = np.random.default_rng(1)
    ids = rng.integers(0, 2**63, 400).astype(np.uint64)
    wa, wb = rng.random(400) * 3, rng.random(400) * 3
    wb[:200] = wa[:200]
    rows = np.repeat([0, 1], 400)
    cells = minhash.unit_cells(rows, np.concatenate([ids, ids]), np.concatenate([wa, wb]))
    s = minhash.dart_signatures(2, *cells, 2000)
    truth = np.minimum(wa, wb).sum() / np.maximum(wa, wb).sum()
    assert abs((s[0] == s[1]).mean() - truth) < 0.04 and (s != 0).all()


def test_minhash_dedup_keeps_one_of_each_class(spark):
    docs = corpus.odd_columns(corpus.documents(spark))
    kept = minhash.dedup(docs)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    classes = weighted_classes([r for r in corpus.rows() if r[0] is not None])
    assert sorted(i for i in ids if i is not None) == sorted(set(classes.values())) and ids.count(None) == 1


def test_minhash_dedup_decides_by_row(spark):
    """Repeated and null ids: a row goes when its own text is a copy, not because it shares an id with one."""
    one, two, three = (f"{w} " * 3 + " ".join(f"{w}{i}" for i in range(40)) for w in ("red", "blue", "green"))
    data = [(3, one), (5, one), (5, two), (5, two), (None, one), (None, three), (None, three), (8, None), (None, "")]
    docs = spark.createDataFrame([(i, t, "en", "a", 1) for i, t in data], corpus.SCHEMA)
    left = Counter((r.doc_id, r.text) for r in minhash.dedup(docs).collect())
    assert left == Counter([(3, one), (5, two), (None, three), (8, None)])


def test_components_of_chains_and_stars(spark):
    chain = [(i, i + 1) for i in range(100, 140)] + [(7, x) for x in range(8, 30)] + [(3, 2)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert {got[i] for i in range(100, 141)} == {100} and {got[i] for i in range(7, 30)} == {7} and got[3] == got[2] == 2


@pytest.mark.parametrize("order", ["random", "falling"])
def test_components_of_long_chains_of_any_numbering(spark, order):
    n = 400
    path = [0, *range(n - 1, 0, -1)] if order == "falling" else np.random.default_rng(3).permutation(n).tolist()
    chain = list(zip(path, path[1:], strict=False)) + [(i + 1000, i + 1001) for i in range(50)] + [(2000, 2000)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == dict.fromkeys(range(n), 0) | dict.fromkeys(range(1000, 1051), 1000) | {2000: 2000}


# suffix dedup


def brute_spans(data, length):
    seen, out = set(), {}
    for i, t in sorted((r[0], r[1]) for r in data):
        b = (t or "").encode()
        cover = np.zeros(len(b), dtype=bool)
        for k in range(len(b) - length + 1):
            if b[k : k + length] in seen:
                cover[k : k + length] = True
            seen.add(b[k : k + length])
        runs = int((cover & ~np.concatenate([[False], cover[:-1]])).sum()) if len(b) else 0
        out[i] = (len(b), int(cover.sum()), runs, hashlib.sha256(bytes(x for x, c in zip(b, cover, strict=True) if not c)).hexdigest())
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_suffix_dedup_matches_brute_force(spark, seed):
    import random

    rng = random.Random(seed)
    data = {r[0]: r for r in corpus.rows(seed) if r[0] is not None}
    passage = corpus.prose(rng, 40)
    for i in range(100, 130):
        data[i] = (i, corpus.prose(rng, rng.randint(0, 20)) + passage[rng.randrange(60) : 200 + rng.randrange(60)] + corpus.prose(rng, rng.randint(0, 20)), "en", "a", 1)
    data[140] = (140, "ab" * 400, "en", "a", 1)
    data[141] = (141, "é" * 149 + "ab" * 60, "en", "a", 1)
    data[142], data[143] = (142, passage[:99], "en", "a", 1), (143, passage[:100], "en", "a", 1)
    docs = corpus.odd_columns(corpus.documents(spark, list(data.values())))
    got = suffix_dedup.dedup_substrings(docs).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got} == brute_spans(data.values(), 100)


@pytest.mark.parametrize("other", [7, None, 1])
def test_suffix_dedup_tells_rows_of_one_id_apart(spark, other):
    """Texts that share an id, or have none, lose only what stands earlier: (1, A), (x, A), (x, B), (x, B) again."""
    import random

    rng = random.Random(3)
    a, b = corpus.prose(rng, 60), corpus.prose(rng, 60)
    c = b[:150] + corpus.prose(rng, 30)
    data = [(1, a), (other, a), (other, b), (other, b), (2, c), (other, None)]
    docs = spark.createDataFrame([(i, t, "en", "a", 1) for i, t in data], corpus.SCHEMA)
    got = {(r.doc_id, r.n_bytes, r.n_removed) for r in suffix_dedup.dedup_substrings(docs).collect()}
    early = other == 1  # then b comes before c
    assert got == {(1, len(a), 0), (other, len(a), 0 if early else len(a)), (other, len(b), 0 if early else 150), (2, len(c), 150 if early else 0), (other, 0, 0)}


def test_column_wise_runs_are_equal_windows():
    rng = np.random.default_rng(0)
    columns = rng.integers(1, 4, (300, 14)).astype(np.uint16)
    columns[rng.random(300) < 0.3, :2] = 0
    groups = np.sort(rng.integers(0, 5, 300)).astype(np.int64)
    for j, order, run in suffix_dedup.equal_windows(groups, columns, 6, 9):
        windows = {}
        for i, r in zip(order, run, strict=True):
            windows.setdefault(r, set()).add((groups[i], i if 0 in columns[i, j : j + 6] else tuple(columns[i, j : j + 6])))
        assert all(len(w) == 1 for w in windows.values()) and len({next(iter(w)) for w in windows.values()}) == len(windows)


def test_marks_meet_in_batches_of_any_size():
    """Equal stretches but the first are later, the firsts of several stretches around a gram are open: however the
    sorted marks are cut into batches, and with those of a few texts thinned out beforehand."""
    rng = np.random.default_rng(5)
    rows = rng.integers(0, [[9], [3], [6], [2], [4]], (5, 400))
    firsts, plain = {}, Counter()
    for h, c, *at in sorted(map(tuple, rows.T.tolist())):
        if firsts.setdefault((h, c), at) != at:
            plain[h, *at, False] += 1
    for (h, c), at in firsts.items():
        if sum(k[0] == h for k in firsts) > 1:
            plain[h, *at, True] += 1
    found = []
    for thin in (False, True):
        got, kept = Counter(), rows
        if thin:
            parts = []
            for k in range(0, 400, 50):
                part = rows[:, k : k + 50]
                keep, later = suffix_dedup.repeated_marks(part[0].astype(np.uint64), part[1].astype(np.uint64), *part[2:])
                parts.append(part[:, keep])
                got.update((h, *at, False) for h, c, *at in part[:, later].T.tolist())
            kept = np.concatenate(parts, axis=1)
            assert kept.shape[1] < 400
        kept = kept[:, np.lexsort(kept[::-1])]
        marks, at = suffix_dedup.Marks(), 0
        while at < kept.shape[1]:
            n = int(rng.integers(0, 4))
            out, open_ = marks.take(kept[:, at : at + n])
            got.update((*r, bool(o)) for r, o in zip(out.T.tolist(), open_, strict=True))
            at += n
        found.append(got)
    # Thinning drops what a document says of itself twice, and nothing else.
    assert found[0] == plain
    assert set(found[1]) == set(plain) and all(found[1][k] == plain[k] for k in plain if k[-1])


def test_suffix_collections_are_laid_out_in_slabs():
    """A collection of 30,000 strings holds its columns (7 MB), not places for each of their bytes (28 MB an array)."""
    import tracemalloc

    rng = np.random.default_rng(0)
    strings = [rng.integers(97, 123, 115).astype(np.uint8).tobytes() for _ in range(15_000)] * 2
    key = np.arange(30_000) // 2
    strings = [strings[k // 2 + 15_000 * (k % 2)] for k in range(30_000)]
    zero = np.zeros(30_000, dtype=np.int64)
    tracemalloc.start()
    who, where = suffix_dedup.later_windows(key, zero, strings, np.arange(30_000), zero, 100, 16)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(who) == 15_000 * 16 and set(who % 2) == {1} and set(where) == set(range(16))
    assert most < 60e6


def test_suffix_marks_are_made_once(spark, monkeypatch):
    """Two tables are written on the way: each file of one costs processes on a local store."""
    names, write = [], suffix_dedup.materialize
    monkeypatch.setattr(suffix_dedup, "materialize", lambda df, name: names.append(name) or write(df, name))
    docs = corpus.documents(spark, [(i, "one and the same text " * 20, "en", "a", 1) for i in range(3)])
    got = {r.doc_id: r.n_removed for r in suffix_dedup.dedup_substrings(docs).collect()}
    assert got[1] == got[2] == 440 and names == ["suffix-marks", "suffix-spans"]


# vectors


def test_vector_links_match_brute_force(spark):
    rng = np.random.default_rng(7)
    base = rng.normal(size=(30, 16))
    v = [(b + rng.normal(size=16) * s).tolist() for b in base for s in (0, 0.05, 0.1, 0.15)]
    data = [(i, x, i % 3) for i, x in enumerate(v)] + [(500 + i, v[0], 0) for i in range(3)]
    data += [(600, None, 1), (601, [0.0] * 16, 1), (602, [float("nan")] + [1.0] * 15, 1), (603, [None] + [1.0] * 15, 1), (604, v[0], None), (None, v[0], 0), (605, [1.0] * 8, 0), (606, [1.0] * 8, 0)]
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>, label int")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in vector_dedup.near_links(corpus.odd_columns(df.withColumnRenamed("label", "lab")).drop("label").withColumnRenamed("lab", "label")).collect()}
    good = [(i, np.array(x), c) for i, x, c in data if i is not None and x and c is not None and all(y is not None and np.isfinite(y) for y in x) and any(x)]
    parent = {i: i for i, *_ in data if i is not None}

    def find(u):
        while parent[u] != u:
            u = parent[u]
        return u

    links = Counter()
    for i, x, c in good:
        for j, y, e in good:
            if i < j and c == e and len(x) == len(y) and x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= 0.93:
                links[i] += 1
                links[j] += 1
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    for i in parent:
        assert got[i] == (links[i], find(i), find(i) == i), i
    assert got[None] == (0, None, True)


def test_hadamard_is_orthonormal():
    x = np.random.default_rng(0).normal(size=(5, 32))
    y = vector_dedup.hadamard(x)
    assert np.allclose(x @ x.T, y @ y.T) and np.allclose(vector_dedup.hadamard(y), x)


@pytest.mark.parametrize("width, crowd", [(64, 1_000), (64, 1_000_000), (384, 5_000), (768, 5_000)])
def test_recall_of_the_tables(width, crowd):
    """Pairs right at the threshold meet in some table, at the shape that is chosen for the width."""
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, width))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    side = rng.normal(size=x.shape)
    side -= (side * x).sum(1, keepdims=True) * x
    side /= np.linalg.norm(side, axis=1, keepdims=True)
    y = 0.93 * x + np.sqrt(1 - 0.93**2) * side
    per_table, tables = vector_dedup.hash_shape(crowd, width, 0.93, 0.9995)
    assert per_table == (2 if crowd > 100_000 else 1)
    a, b = (vector_dedup.probe_codes(v, tables, per_table) for v in (x, y))
    met = (a[:, :, :, None] == b[:, :, None, :]).any(axis=(1, 2, 3))
    assert met.mean() > 0.98


def test_vector_chains_are_one_component(spark):
    """A vector whose only neighbour has a lesser neighbour of its own: 3 - 7 - 5, and long chains of any numbering."""
    turn = np.deg2rad(15)
    at = lambda k, plane: [0.0] * (2 * plane) + [float(np.cos(k * turn)), float(np.sin(k * turn))] + [0.0] * (14 - 2 * plane)
    data = [(3, at(0, 0), 1), (7, at(1, 0), 1), (5, at(2, 0), 1)] + [(int(i), at(k, 3), 1) for k, i in enumerate(np.random.default_rng(1).permutation(12) + 100)]
    got = {r.vec_id: (r.n_links, r.component_id) for r in vector_dedup.near_links(spark.createDataFrame(data, "vec_id long, embedding array<double>, label int")).collect()}
    assert [got[i] for i in (3, 7, 5)] == [(1, 3), (2, 3), (1, 3)] and {got[i][1] for i in got if i >= 100} == {100}


def test_tiles_count_like_one_bucket(spark, monkeypatch):
    """A dense group that is cut into many tiles, with vectors that share an id."""
    rng = np.random.default_rng(2)
    base = rng.normal(size=16)
    v = base + rng.normal(size=(150, 16)) * 0.25
    data = [(i % 140, x.tolist(), 1) for i, x in enumerate(v)]
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>, label int")
    monkeypatch.setattr(vector_dedup, "TILE", 16)
    got = Counter((r.vec_id, r.n_links, r.component_id) for r in vector_dedup.near_links(df).collect())
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    ids = np.arange(150) % 140
    hit = (u @ u.T >= 0.93) & (ids[:, None] != ids)
    comp = ids.copy()
    for _ in range(150):
        comp = np.array([min([comp[i], *comp[hit[i]], *comp[ids == ids[i]]]) for i in range(150)])
    assert got == Counter(zip(ids.tolist(), hit.sum(1).tolist(), comp.tolist(), strict=True)) and hit.sum() > 1000


# every operator on an empty table


def test_empty_tables(spark):
    docs = corpus.documents(spark, [])
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    vectors = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    frames = [
        line_dedup.dedup_lines(docs), quality.classify(docs, labels), language_id.identify(docs), mixing.mix(docs)[0], suffix_dedup.dedup_substrings(docs), media.read_media(media.store_media(docs)),
        vector_dedup.near_links(vectors), packing.pack(docs, packing.default_tokenizer()), minhash.classes(docs), minhash.dedup(docs), license_scan.scan_licenses(docs),
    ]
    assert [f.count() for f in frames] == [0] * len(frames)


def test_null_ids_repeated_rows_and_clashing_columns(spark):
    """Every operator returns a row per input row (packing a first piece), and repeated rows get equal results."""
    data = corpus.rows()
    docs = corpus.odd_columns(corpus.documents(spark))
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(0, 40)] + [(None, 1, 0)], "doc_id long, quality int, toxic int")
    results = {
        "lines": line_dedup.dedup_lines(docs).select(F.col("doc_id").alias("i"), "_n_lines", "_n_dropped", "_kept"),
        "quality": quality.classify(docs, labels).select(F.col("doc_id").alias("i"), "_expected_grade", "_kept"),
        "language": language_id.identify(docs).withColumnRenamed("doc_id", "i"),
        "suffix": suffix_dedup.dedup_substrings(docs).withColumnRenamed("doc_id", "i").drop("kept"),
        "media": media.read_media(media.store_media(docs)).withColumnRenamed("doc_id", "i").drop("embedded"),
        "pack": packing.pack(docs, packing.default_tokenizer()).filter("piece = 0").select(F.col("doc_id").alias("i"), "start", "length", "ids_crc32"),
        "minhash": minhash.classes(docs).withColumnRenamed("id", "i"),
        "license": license_scan.scan_licenses(docs).withColumnRenamed("doc_id", "i").drop("blocks"),
    }
    for name, df in results.items():
        got = [tuple(r) for r in df.collect()]
        assert Counter(r[0] for r in got) == Counter(r[0] for r in data), name
        twins = [r for r in got if r[0] == data[3][0]]
        assert len(twins) == 2 and twins[0] == twins[1], name


def test_long_text_stays_whole(spark):
    text = "\n".join(f"line {i} of a very long document that goes on" for i in range(30_000))
    docs = spark.createDataFrame([(1, text, "en", "a", len(text)), (2, "line 7 of a very long document that goes on", "en", "a", 1)], corpus.SCHEMA)
    lines = {r.doc_id: r for r in line_dedup.dedup_lines(docs).collect()}
    assert lines[1]._n_lines == 30_000 and lines[1]._n_dropped == 0 and lines[2]._n_dropped == 1
    assert packing.pack(docs, packing.default_tokenizer()).filter("doc_id = 1").agg(F.sum("length")).first()[0] > 200_000
    assert {r.id: r.class_id for r in minhash.classes(docs).collect()} == {1: 1, 2: 2}
    assert media.read_media(media.store_media(docs)).filter("doc_id = 1").first().n_bytes == len(text)
