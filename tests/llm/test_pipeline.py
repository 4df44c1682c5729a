"""The pipeline stage by stage against brute force, each on its own input."""

from collections import Counter, defaultdict

import corpus_pipeline
import pytest

from .fixtures import SCHEMA, components, edge_rows, shingles
from .test_operators import brute_lines, n_words

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.createDataFrame(edge_rows(), SCHEMA).select(*COLUMNS)
    out = [docs]
    for _, stage in corpus_pipeline.STAGES:
        last = stage(spark, out[-1], "/nowhere")
        out.append(spark.createDataFrame(last.collect(), last.schema))
    return out


def test_stages_keep_the_columns(stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "line dedup", "minhash near-dedup", "mixing", "packing"]
    assert all(s.columns == COLUMNS for s in stages[:-1])


def test_classifier_only_drops(stages):
    before, after = (Counter(map(tuple, s.collect())) for s in stages[:2])
    assert not after - before and sum(after.values()) >= 0.7 * sum(before.values())
    assert all((r[1] or "").strip() for r in after)


def test_line_dedup(stages):
    import hashlib

    want = Counter((r[0], r[3]) for r in brute_lines([tuple(r) for r in stages[1].collect()]))
    assert Counter((r["doc_id"], hashlib.sha256((r["text"] or "").encode()).hexdigest()) for r in stages[2].collect()) == want
    assert all(r["n_chars"] == len(r["text"]) for r in stages[2].collect())


def test_near_dedup(stages):
    rows = stages[2].collect()
    sets = [shingles(r["text"]) for r in rows]
    links = [(i, j) for i in range(len(sets)) for j in range(i) if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j])]
    want = Counter()
    for g in {tuple(g) for g in components(len(rows), links)}:
        ids = [rows[i]["doc_id"] for i in g if rows[i]["doc_id"] is not None]
        want[min(ids) if ids else None] += 1
    got = Counter(r["doc_id"] for r in stages[3].collect())
    assert got == want


def test_mixing(stages):
    sizes = defaultdict(int)
    for r in stages[3].collect():
        sizes[r["source"]] += n_words(r["text"])
    taken = defaultdict(int)
    for r in stages[4].collect():
        taken[r["source"]] += n_words(r["text"])
    assert max(Counter(tuple(r) for r in stages[4].collect()).values()) <= 2
    assert abs(sum(taken.values()) - 1.5 * sum(sizes.values())) <= sum(max(n_words(r["text"]) for r in stages[3].collect()) for _ in sizes)


def test_packing(stages):
    pieces = stages[5].collect()
    assert Counter(r["doc_id"] for r in pieces if r["start"] == 0) == Counter(r["doc_id"] for r in stages[4].collect())
    lengths = defaultdict(int)
    for r in pieces:
        lengths[r["sequence_id"]] += r["length"]
    assert max(lengths.values()) <= 2048


def test_an_empty_table_passes_every_stage(spark):
    docs = spark.createDataFrame([], SCHEMA)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, "/nowhere")
        assert out.count() == 0, name
        docs = spark.createDataFrame([], out.schema)


def test_rows_without_ids_and_with_clashing_columns(spark):
    """Many equal rows with a null id, and extra columns that operators might use themselves."""
    rows = edge_rows() + [(None, "the same words stand here again and again, and nothing tells these rows apart.", "en", "src1", 77, 1, "c", 2, "s", 3, 4)] * 60
    docs = spark.createDataFrame(rows, SCHEMA)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, "/nowhere")
        assert docs.columns == [f.split()[0] for f in SCHEMA.split(", ")]
        docs = spark.createDataFrame(docs.collect(), docs.schema)
    assert corpus_pipeline.STAGES[-1][1](spark, docs, "/nowhere").count() > 0


def test_the_rest_works_without_these_folders(tmp_path):
    import os
    import shutil
    import subprocess
    import sys

    root = os.path.dirname(os.path.abspath(corpus_pipeline.__file__))
    shutil.copytree(f"{root}/lintel", tmp_path / "lintel", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{root}/__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert q and not any(n.startswith('op') for n in q) and 'pipeline' not in q and set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={**os.environ, "PYTHONPATH": str(tmp_path)})
