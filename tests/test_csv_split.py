"""CSV files read in many splits against Python's reader and Spark's one-task reader."""

from __future__ import annotations

import csv
import io
import random
from collections import Counter

import pytest

from framescope.session import scratch_path
from framescope.sources import corpora
from framescope.sources.csv_split import csv_records, open_after

VALUES = [
    'say "x", then', "two\nlines", " padded ", "back\\slash", "comma,", 'ends "', '"', '""', "\n", "\n\n\n", 'a"\n"b', "é😀", "plain",
    ',"\n,"', "long " * 300, "line\r\nends", "x" * 2000, '"quoted whole"', "\n" * 50, "tab\t",
]


def rows(n, seed):
    rng = random.Random(seed)
    return [(i, "".join(rng.choice(VALUES) for _ in range(rng.randint(1, 3))), str(i % 2), "s") for i in range(n)]


@pytest.fixture()
def tiny_splits(spark):
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    yield lambda size: spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    for key, value in old.items():
        spark.conf.set(key, value)


@pytest.mark.parametrize("size", ["600", "5000", "128m"])
def test_rows_are_those_of_the_one_task_reader(spark, tiny_splits, size):
    given = rows(400, 1)
    path = scratch_path(spark, "csv")
    frame = spark.createDataFrame(given, corpora.CORPUS_SCHEMA)
    corpora.write_corpus(frame.repartition(2), path)
    single = (
        spark.read.schema(corpora.CORPUS_SCHEMA).option("header", True).option("multiLine", True).option("escape", '"')
        .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path).collect()
    )
    tiny_splits(size)
    split = corpora.read_corpus_csv(spark, path)
    assert Counter(split.collect()) == Counter(single)
    tasks = spark.read.text(path).rdd.getNumPartitions()
    assert tasks > 50 if size == "600" else tasks >= 1
    assert csv_records(spark, path).filter("header").count() == 2


def test_mixed_quoting_and_odd_files(spark, tiny_splits, tmp_path):
    out = io.StringIO()
    writer = csv.writer(out, lineterminator="\n")  # quotes only where needed
    writer.writerow(["doc_id", "text", "label", "source"])
    given = rows(200, 2)
    writer.writerows(given)
    (tmp_path / "a.csv").write_text(out.getvalue(), newline="")
    (tmp_path / "b.csv").write_text('doc_id,text,label,source\n1000,in "quotes" inside,1,s\n\n\n1001,"open to the end\nof file', newline="")
    (tmp_path / "c.csv").write_text("", newline="")
    want = {i: text for i, text, *_ in given}
    for size in ("300", "128m"):
        tiny_splits(size)
        got = corpora.read_corpus_csv(spark, str(tmp_path)).collect()
        texts = {r["doc_id"]: r["text"] for r in got}
        assert len(got) == 202
        assert {i: t for i, t in texts.items() if i < 1000} == want
        assert texts[1000] == 'in "quotes" inside' and texts[1001].startswith("open to the end")


def test_open_after_follows_every_character():
    def by_hand(line, inside):
        state = "in" if inside else "start"
        for c in line:
            if state == "in":
                state = "quote" if c == '"' else "in"
            elif state == "quote":
                state = "in" if c == '"' else "start" if c == "," else "out"
            else:
                state = "start" if c == "," else "in" if c == '"' and state == "start" else "out"
        return state == "in"

    rng = random.Random(3)
    for _ in range(20_000):
        line = "".join(rng.choice('",,"ab ') for _ in range(rng.randint(0, 12)))
        for inside in (False, True):
            assert open_after(line, inside) == by_hand(line, inside), (line, inside)
