from collections import Counter

import pytest

pytest.importorskip("public_tokenizers")
import corpus_pipeline as P  # noqa: E402
from lodestone.llm import quality_rules  # noqa: E402
from tests.llm.test_dedup import components  # noqa: E402
from tests.llm.test_models import brute_spans  # noqa: E402


def test_stages(spark, docs, tmp_path):
    names = [n for n, _ in P.STAGES]
    assert names == ["quality rules", "n-gram jaccard join", "secret scans", "source mixing", "packing"]
    at, seen = docs, [docs]
    for k, (_, stage) in enumerate(P.STAGES):
        stage(spark, at, str(tmp_path)).write.parquet(str(tmp_path / f"{k}"))
        at = spark.read.parquet(str(tmp_path / f"{k}"))
        if k < len(P.STAGES) - 1:
            assert at.columns == docs.columns
        seen.append(at)
    good = Counter(r.doc_id for r in quality_rules.score(docs).where("kept").collect())
    assert Counter(r.doc_id for r in seen[1].collect()) == good
    first = [tuple(r) for r in seen[1].collect()]
    assert {r.doc_id for r in seen[2].collect()} - {None} == {c for _, _, c in components(first, 5, 80)} - {None}
    assert Counter(r.doc_id for r in seen[3].collect()) == Counter(r.doc_id for r in seen[2].collect())
    assert not any(any(brute_spans(r.text or "")) for r in seen[3].collect())
    copies = Counter(r.doc_id for r in seen[4].collect())
    packed = Counter()
    for r in seen[5].collect():
        packed[r.doc_id] += r.length / r.doc_tokens
    assert {d: round(x, 6) for d, x in packed.items()} == {d: float(x) for d, x in copies.items()}


def test_run(spark, docs, tmp_path):
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    assert P.run(spark, str(tmp_path)).count() > 0 and P.ORACLE_SQL is None
