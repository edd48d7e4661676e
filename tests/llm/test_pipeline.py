"""Each stage of the corpus pipeline on what its predecessor kept, against a plain version."""

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))

import plain  # noqa: E402
from test_operators import check_pieces  # noqa: E402

import corpus_pipeline  # noqa: E402
from waveledger.llm import quality_rules  # noqa: E402
from waveledger.llm.shared import table  # noqa: E402
from waveledger.sources import tables  # noqa: E402
from waveledger.sources.tables import staged  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    """The documents, and what each stage made of its predecessor's."""
    made = [table(spark, SF, "documents")]
    for _, stage in corpus_pipeline.STAGES:
        made.append(staged(stage(spark, made[-1], SF), "stage"))
    return made


def rows(df):
    return {r.doc_id: r for r in df.collect()}


def test_order_and_columns(stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == [
        "quality rules", "line dedup", "SimHash near-dedup", "suffix-array dedup", "packing"]
    for made in stages[1:-1]:
        assert made.columns == stages[0].columns and made.dtypes == stages[0].dtypes
        assert made.count() == made.select("doc_id").distinct().count() > 0


def test_rules(stages):
    before, after = rows(stages[0]), rows(stages[1])
    kept = {r.doc_id for r in quality_rules.rate_documents(stages[0]).collect() if r.kept}
    assert set(after) == kept and all(after[d] == before[d] for d in kept)


def test_lines(stages):
    before, after = rows(stages[1]), rows(stages[2])
    want = plain.lines([(d, r.text) for d, r in before.items()])
    assert {d: r.text for d, r in after.items()} == {d: w[2] for d, w in want.items()}
    assert all(r.n_chars == len(r.text) and r.source == before[d].source for d, r in after.items())


def test_near_copies(stages):
    before, after = rows(stages[2]), rows(stages[3])
    want = plain.near_documents([(d, r.text) for d, r in before.items()])
    assert set(after) == {c for _, c in want.values()} and all(after[d] == before[d] for d in after)


def test_substrings(stages):
    before, after = rows(stages[3]), rows(stages[4])
    want = plain.substrings([(d, r.text) for d, r in before.items()])
    assert {d: r.text for d, r in after.items()} == {d: w[0].decode(errors="ignore") for d, w in want.items()}
    assert all(r.n_chars == len(r.text) for r in after.values())


def test_packed(stages):
    check_pieces([(d, r.text) for d, r in rows(stages[4]).items()], stages[5].collect())


def test_run_is_the_stages(spark, stages):
    folder = Path(tables._stage_dir(spark))
    before = set(folder.iterdir())
    got = corpus_pipeline.run(spark, SF)
    # of what the stages have written, the last documents and what packing needs are left
    assert sorted(p.name.split("-")[0] for p in set(folder.iterdir()) - before).count("corpus") == 1
    assert not any(p.name.startswith(("anchors", "edges", "features")) for p in set(folder.iterdir()) - before)
    assert got.columns == stages[5].columns
    assert sorted(map(str, got.drop("sequence_id", "offset").collect())) == sorted(
        map(str, stages[5].drop("sequence_id", "offset").collect()))
