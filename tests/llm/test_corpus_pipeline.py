"""The pipeline against a brute-force reading of what each stage kept."""

import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import tiktoken

import corpus_pipeline
from locusforge.llm import registry
from locusforge.llm.byte_bpe import read_ranks
from locusforge.llm.common import table
from tests.llm.test_mixing import brute_targets

KIND = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(11)
    out = tmp_path_factory.mktemp("corpus")
    vocabulary = [f"w{chr(97 + i)}{chr(97 + j)}" for i in range(20) for j in range(20)]
    docs, labels = [], []
    for i in range(500):
        words = rng.choices(vocabulary, k=rng.randint(60, 160))
        toxic = i % 6 == 0
        if toxic:
            words[5:5] = ["zorgling", "fiend"]
        docs.append([i, " ".join(words), "en", f"src{i % 4}", 0])
        labels.append((i, 1, int(toxic)))
    for k in range(30):  # exact and near copies of clean documents
        base = docs[6 * k + 1][1]
        docs.append([1000 + k, base, "en", "src1", 0])
        words = base.split()
        words[len(words) // 2] = "changed"
        docs.append([2000 + k, " ".join(words), "en", "src2", 0])
    docs += [[3000, None, None, None, None], [3001, "", "xx", None, 0], [3002, "word " * 3000, "en", "src0", 0]]
    for d in docs:
        d[4] = None if d[1] is None else len(d[1])
    spark.createDataFrame([tuple(d) for d in docs], KIND).write.parquet(str(out / "documents.parquet"))
    spark.createDataFrame(labels[:400], "doc_id long, quality int, toxic int").write.parquet(str(out / "labels.parquet"))
    return str(out)


def test_stages(spark, folder):
    docs = table(spark, folder, "documents")
    kept = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, folder)
        assert [f.simpleString() for f in docs.schema] == [f.simpleString() for f in table(spark, folder, "documents").schema], name
        docs = spark.createDataFrame(docs.collect(), KIND)
        kept.append(docs.collect())
    toxic = {i for i in range(0, 500, 6)}
    first = {r.doc_id for r in kept[0]}
    assert len(toxic & first) <= 2 and len(first) >= 560 - len(toxic) - 2
    assert Counter(r.text or "" for r in kept[1]) == Counter({r.text or "": 1 for r in kept[0]})
    for text, r in {(r.text or ""): r for r in kept[1]}.items():
        assert r.doc_id == min(x.doc_id for x in kept[0] if (x.text or "") == text)
    near = {r.doc_id for r in kept[2]}
    copies = [2000 + k for k in range(30) if 6 * k + 1 in first]
    assert sum(c not in near for c in copies) >= 0.85 * len(copies)
    assert {r.doc_id for r in kept[1] if r.doc_id < 1000} <= near  # unrelated documents stay
    sizes = Counter()
    for r in kept[2]:
        sizes[r.source] += len((r.text or "").split())
    target, taken, top = brute_targets(dict(sizes)), Counter(), Counter()
    for r in kept[3]:
        taken[r.source] += len((r.text or "").split())
    for r in kept[2]:
        top[r.source] = max(top[r.source], len((r.text or "").split()))
    assert all(abs(taken[s] - target[s]) <= top[s] / 2 + 1e-6 for s in sizes)
    reference = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")), special_tokens={})
    want = Counter()
    for r in kept[3]:
        ids = reference.encode_ordinary(r.text or "")
        want[(r.doc_id, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest())] += 1
    assert Counter(map(tuple, corpus_pipeline.encode(spark, docs, folder).collect())) == want


def test_run_and_registry(spark, folder):
    assert corpus_pipeline.run(spark, folder).count() > 400
    names = list(registry.queries())
    assert [n.split("_")[0] for n in names] == [f"op{i}" for i in range(1, 11)]
    assert set(registry.oracle_sql()) <= set(names)
