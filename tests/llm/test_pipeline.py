import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from photonlake.llm import mixing, packing, pipeline, registry
from photonlake.llm.common import materialize
from tests.llm import corpus
from tests.llm.test_operators import brute_lines, weighted_classes


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("tables"))
    docs = corpus.documents(spark)
    docs.write.parquet(f"{d}/documents.parquet")
    rows = [(i, int(i % 5 != 0), 0) for i in range(50)]
    spark.createDataFrame(rows, "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    return d


def test_stages_act_on_what_is_left(spark, folder):
    docs, outs = spark.read.parquet(f"{folder}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        docs = materialize(stage(spark, docs, folder), name)
        outs.append(docs)
    columns = spark.read.parquet(f"{folder}/documents.parquet").columns
    assert all(o.columns == columns for o in outs[:-1])
    data = [o.collect() for o in outs]
    with_id = lambda rows: [tuple(r) for r in rows if r.doc_id is not None]
    lines = brute_lines(list({r[0]: r for r in with_id(data[0])}.values()))
    for i, text, *_ in with_id(data[1]):
        assert hashlib.sha256((text or "").encode()).hexdigest() == lines[i][2]
    classes = weighted_classes(list({r[0]: r for r in with_id(data[1])}.values()))
    assert sorted(r[0] for r in with_id(data[2])) == sorted(set(classes.values()))
    assert {r[0] for r in with_id(data[3])} <= {r[0] for r in with_id(data[2])}
    assert {r.doc_id for r in data[4]} == {r.doc_id for r in data[3]}


def test_run_equals_the_stages(spark, folder):
    """run() packs exactly the documents that the four stages before leave, in whole texts with every copy."""
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = materialize(stage(spark, docs, folder), name)
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(packing.default_tokenizer())
    want = Counter()
    for r in docs.collect():
        ids = tok.encode(r.text or "", add_special_tokens=False).ids + [2]
        head = len(ids) % 1024 or 1024
        cuts = [0, *range(head, len(ids) + 1, 1024)] if len(ids) > 1024 else [0, len(ids)]
        for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
            want[r.doc_id, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())] += 1
    got = corpus_pipeline.run(spark, folder).collect()
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    room = Counter()
    for r in got:
        room[r.sequence_id] += r.length
    assert max(room.values()) <= 1024


def test_mixing_stage_copies_rows_by_their_own_share(spark):
    """Null and repeated ids: each row comes as often as its own source's target says, in slot order."""
    data = [(None, " ".join(f"a{i}" for i in range(40)), "en", "a", 1), (None, " ".join(f"b{i}" for i in range(10)), "en", "b", 1), (4, "a b c", "en", "a", 1), (4, "a b c", "en", "a", 1), (4, "d e f", "en", "b", 1)]
    data += [(100 + i, corpus.prose(random.Random(i), 50), "de", "c", 1) for i in range(30)]
    docs = spark.createDataFrame(data, corpus.SCHEMA)
    rows = mixing.mix(docs)[0].collect()
    want = Counter()
    for r in rows:
        text = next(t for i, t, _, s, _ in data if i == r.id and len(t.split()) == r.size and r.source_size == sum(len(x[1].split()) for x in data if x[3] == s))
        want[r.id, text] += int(r.taken / r.size + 0.5)
    out = pipeline.mixing_stage(spark, docs, "")
    got = out.collect()
    assert Counter((r.doc_id, r.text) for r in got) == +want and out.columns == docs.columns
    share = Counter()
    for r in got:
        share[r.source] += len(r.text.split())
    target = {s: next(r.target for r in rows if r.source_size == sum(len(x[1].split()) for x in data if x[3] == s)) for s in "abc"}
    assert all(abs(share[s] - target[s]) <= max(len(x[1].split()) for x in data if x[3] == s) / 2 + 1 for s in "abc")


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_queries_return_a_row_per_document(spark, name):
    d = "/root/testdata/sf0.001"
    out = registry.queries()[name](spark, d)
    n = spark.read.parquet(f"{d}/{'embeddings' if name.startswith('op7') else 'documents'}.parquet").count()
    got = out.count()
    assert got >= n if name.startswith("op8") else got > 0 if name == "pipeline" else got == n
