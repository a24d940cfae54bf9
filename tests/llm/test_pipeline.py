"""The pipeline's stages, each on what its predecessor kept, against brute force; and run() against the chain of them."""

import collections
import os
import re
import subprocess
import sys

import numpy as np
import pyspark
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from packlens.llm import decontam, jaccard, toxicity
from packlens.llm.common import table
from packlens.llm.queries import BPE, MIN_SITES

from .test_operators import LOW, groups_of, linked_windows

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def rows_of(df):
    return sorted((tuple(r) for r in df.select(*COLUMNS).collect()), key=repr)


def kept_by_score(spark, rows):
    model = toxicity.ToxicityModel.train(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"), table(spark, SF, "labels"))
    out = []
    for r in rows:
        found = {f for t in toxicity.tokens_of(r[1] or "") for f in toxicity.features_of(toxicity.restore(t, model.lm)) if f in model.features}
        if 1 / (1 + np.exp(-(model.intercept + sum(model.weights[model.features[f]] for f in found)))) < 0.5:
            out.append(r)
    return out


def deduped(rows):
    sites, first = collections.defaultdict(set), {}
    for i, t, _, s, _ in sorted(rows, key=lambda r: r[0]):
        for p, x in enumerate((t or "").split("\n")):
            if x.strip(" "):
                sites[x.strip(" ")].add(s)
                first.setdefault(x.strip(" "), (i, p))
    out = []
    for i, t, lang, s, n in rows:
        lines = (t or "").split("\n")
        keep = [x for p, x in enumerate(lines) if not (x.strip(" ") and len(sites[x.strip(" ")]) >= MIN_SITES and first[x.strip(" ")] != (i, p))]
        new = "\n".join(keep)
        if len(keep) == len(lines):
            out.append((i, t, lang, s, n))
        elif new.strip(" "):
            out.append((i, new, lang, s, len(new)))
    return out


def clean_of(rows, bench):
    words = lambda t: re.findall(decontam.WORD, (t or "").translate(LOW))
    windows = set()
    for t in bench:
        w = words(t)
        windows |= {tuple(w[a : a + 10]) for a in range(max(1, len(w) - 9) if w else 0)}
    sizes = {len(x) for x in windows}
    return [r for r in rows if not any(tuple(w[a : a + n]) in windows for w in [words(r[1])] for n in sizes for a in range(len(w) - n + 1))]


@pytest.fixture(scope="module")
def staged(spark, tmp_path_factory):
    docs, out = table(spark, SF, "documents"), []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        path = str(tmp_path_factory.mktemp("stage") / str(k))
        stage(spark, docs, SF).write.parquet(path)
        before, docs = docs, spark.read.parquet(path)
        out.append((before, docs))
    return out


def test_stages_match_brute_force(spark, staged):
    (docs, safe), (_, lines), (_, single), (_, clean), (_, packed) = staged
    assert rows_of(safe) == sorted(kept_by_score(spark, [tuple(r) for r in docs.select(*COLUMNS).collect()]), key=repr)
    assert rows_of(lines) == sorted(deduped([tuple(r) for r in safe.select(*COLUMNS).collect()]), key=repr)
    before = [tuple(r) for r in lines.select(*COLUMNS).collect()]
    groups = groups_of([(r[0], r[1], "") for r in before])
    assert rows_of(single) == sorted((r for r in before if groups[r[0]][1] == r[0]), key=repr)
    bench = [r.text for r in table(spark, SF, "benchmark").collect()]
    assert rows_of(clean) == sorted(clean_of([tuple(r) for r in single.select(*COLUMNS).collect()], bench), key=repr)
    tok = Tokenizer.from_file(BPE)
    want = {r.doc_id: len(tok.encode(r.text or "", add_special_tokens=False).ids) + 1 for r in clean.collect()}
    got = collections.Counter()
    for r in packed.collect():
        got[r.doc_id] += r.length
    assert got == want


def test_run_is_the_chain_of_stages(spark, staged):
    key = lambda r: (r.doc_id, r.piece, r.start, r.length, r.ids_crc32)
    assert sorted(map(key, corpus_pipeline.run(spark, SF).collect())) == sorted(map(key, staged[-1][1].collect()))


def test_stages_take_empty_tables_and_extra_columns(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long, score double, extra string")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, SF).count() == 0 and stage(spark, docs, SF).columns == docs.columns
    odd = spark.createDataFrame([(1, None, None, None, None, 0.1, "a"), (2, "", "en", "s", 0, 0.2, "b"), (2, "", "en", "s", 0, 0.2, "b"), (None, "some words", "en", "s", 9, None, None)], docs.schema)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, odd, SF).count() == 4


def test_stages_keep_columns_named_like_their_own(spark):
    line = "the same line on every site"
    rows = [(i, f"{line}\nown words of document {i} {'word ' * 30_000 if i == 3 else ''}", "en", f"s{i}", 9, 77, 88, 0.5, 0.25) for i in range(5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, N_lines int, n_removed int, toxicity double, component_id double")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns
        got = out.collect()
        assert sorted(r.doc_id for r in got) == [0, 1, 2, 3, 4]
        assert {(r.N_lines, r.n_removed, r.toxicity, r.component_id) for r in got} == {(77, 88, 0.5, 0.25)}


def test_large_blocks_are_not_broadcast(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK_SHINGLES", 50)  # one block of over 350 chunks: 3 MB of units
    rows = [(*r, "en", len(r[1])) for r in linked_windows(150)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, n_chars long")
    for k, v in (("spark.sql.maxBroadcastTableSize", "1200k"), ("spark.sql.autoBroadcastJoinThreshold", "-1")):
        spark.conf.set(k, v)
    try:
        got = corpus_pipeline.near_duplicate_stage(spark, docs, SF).collect()
    finally:
        spark.conf.unset("spark.sql.maxBroadcastTableSize")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert sorted(r.doc_id for r in got) == list(range(150))


#: Prints the MB that an executor holds with dead rows on its heap, and after release().
HELD = """
import os
from pathlib import Path
from pyspark.sql import SparkSession
from packlens.llm.common import release

def held(_):
    daemon = Path(f"/proc/{os.getppid()}/status").read_text().split("PPid:")[1].split()[0]
    return int(Path(f"/proc/{daemon}/status").read_text().split("VmRSS:")[1].split()[0]) // 1024

conf = {"spark.ui.enabled": "false", "spark.driver.host": "127.0.0.1", "spark.executor.memory": "1g", "spark.sql.inMemoryColumnarStorage.compressed": "false"}
spark = SparkSession.builder.master("local-cluster[1,1,1024]").config(map=conf).getOrCreate()
rows = spark.range(0, 40_000_000, 1, 4).cache()
rows.count()
rows.unpersist(True)
size = lambda: spark.sparkContext.parallelize([0], 1).map(held).collect()[0]
before = size()
release(spark)
print("held", before, size(), flush=True)
os._exit(0)
"""


def test_release_shrinks_the_heap_of_executors(tmp_path):
    top = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    home = tmp_path / "home"  # executors log to work in Spark's home
    (home / "work").mkdir(parents=True)
    spark_home = os.path.dirname(pyspark.__file__)
    for name in os.listdir(spark_home):
        if name != "work":
            (home / name).symlink_to(f"{spark_home}/{name}")
    env = os.environ | {"PYTHONPATH": top, "PYSPARK_PYTHON": sys.executable, "SPARK_HOME": str(home), "SPARK_SCALA_VERSION": "2.13", "SPARK_LOCAL_IP": "127.0.0.1", "SPARK_LOCAL_DIRS": str(tmp_path / "local")}
    env = {k: v for k, v in env.items() if k not in ("PYSPARK_GATEWAY_PORT", "PYSPARK_GATEWAY_SECRET")}
    out = subprocess.run([sys.executable, "-c", HELD], env=env, cwd=tmp_path, capture_output=True, text=True, timeout=120)
    before, after = map(int, re.search(r"held (\d+) (\d+)", out.stdout).groups())
    assert after < before - 200, (before, after)


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_stages_release_memory_first(name, stage, monkeypatch):
    class Released(Exception):
        pass

    def release(_):
        raise Released

    monkeypatch.setattr(corpus_pipeline, "release", release)
    with pytest.raises(Released):
        stage(None, None, SF)
