"""The pipeline's stages on planted rows, and the package without the training-data operators."""

from __future__ import annotations

import random
import shutil
import subprocess
import sys
from pathlib import Path

import corpus_pipeline
from emberline.llm.common import table, written

REPO = Path(__file__).parents[2]


def planted(spark, folder: Path) -> None:
    rng = random.Random(9)
    words = ["".join(rng.choice("aeiourstlnmd") for _ in range(rng.randint(2, 8))) for _ in range(3000)]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    rows, labels = [], []
    for i in range(400):
        t = text(rng.randint(30, 90))
        if i % 5 == 0:
            w = t.split(" ")
            for _ in range(4):
                w.insert(rng.randrange(len(w)), rng.choice(["blorgface", "zwickster"]))
            t = " ".join(w)
        rows.append((i, t))
        labels.append((i, 1, int(i % 5 == 0)))
    item = text(40)
    near = text(120).split(" ")
    other = [*near[:60], "swapped", *near[61:]]
    rows += [(1000, rows[1][1].replace(" ", " \n")), (1001, " ".join(near)), (1002, " ".join(other)), (1003, text(20) + " " + item + " " + text(20)), (1004, item), (1005, ""), (1006, None)]
    folder.mkdir()
    spark.createDataFrame([(d, t, "en", "s", len(t or "")) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")


def test_stages_do_what_they_say(spark, tmp_path):
    planted(spark, tmp_path / "sf")
    sf, kept = str(tmp_path / "sf"), {}
    docs = table(spark, sf, "documents")
    start = {r.doc_id: r.text for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = written(stage(spark, docs, sf), name)
        assert out.columns == docs.columns
        docs, kept[name] = out, {r.doc_id: r for r in out.collect()}
    clean = {i for i in range(400) if i % 5}
    assert clean <= set(kept["toxicity"]) and not {i for i in range(0, 400, 5)} & set(kept["toxicity"])
    assert set(kept["toxicity"]) - set(kept["exact_dedup"]) == {1000, 1006}  # the null text equals the empty one
    assert set(kept["exact_dedup"]) - set(kept["near_dedup"]) == {1002}
    last = kept["decontaminate"]
    assert set(kept["near_dedup"]) - set(last) == {1004}
    assert len(last[1003].text.split()) == 40 and last[1003].n_chars == len(last[1003].text)
    assert all(last[i].text == start[i] for i in clean)
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, sf).collect()
    assert {r.doc_id for r in pieces} == set(last)


def test_rest_works_without_them(tmp_path):
    for name in ("emberline", "__spark_entry__.py"):
        src = REPO / name
        shutil.copytree(src, tmp_path / name, ignore=shutil.ignore_patterns("llm", "__pycache__")) if src.is_dir() else shutil.copy(src, tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 100 and not any(x.startswith('op') and x[2].isdigit() for x in q) and 'pipeline' not in q and set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, timeout=120)
