import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
import numpy as np

from pinloom.cli import main
from pinloom.model import Hypergraph
from pinloom.options import Metric, Options, Weights
from pinloom.sources import structural
from pinloom.sources.export import write_partition
from pinloom.sources.matrix_lines import load_lines, loaded_pins, parse_banner
from pinloom.sources.mtx import MatrixMarketError, random_pins, read_hypergraph, write_matrix

BANNER = "%%MatrixMarket matrix coordinate {} {}"
THREE = BANNER.format("pattern", "general") + "\n% note\n\n3 3 4\n1 1\n2 1\n2 2\n1 3\n"


def fields_of(line):
    """The plain definition of a line's fields: (text, quoted or not, stray quote) one by one."""
    out = []
    for f in re.split("[ \t]+", line.removesuffix("\r").strip(" \t")):
        if len(f) >= 2 and f[0] == f[-1] == '"':
            f = f[1:-1]
        out.append(f)
    return [f for f in out if f or line.strip(" \t\r")] if line.removesuffix("\r").strip(" \t") else []


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet='12 \t\r".x-+e', max_size=14), min_size=1, max_size=8))
def test_structural_index_agrees_with_splitting_one_by_one(lines):
    lines = [s.replace("\n", "") for s in lines]
    data = np.frombuffer("".join(lines).encode(), np.uint8)
    ends = np.cumsum([len(s.encode()) for s in lines])
    ix = structural.index(data, np.concatenate(([0], ends[:-1])), ends)
    for i, line in enumerate(lines):
        mine = [(data[ix.start[f]:ix.end[f]].tobytes().decode(), bool(ix.stray[f])) for f in range(ix.first[i], ix.first[i] + ix.count[i])]
        want = fields_of(line)
        if line.count('"') == 0:
            assert [m[0] for m in mine] == want
        whole = lambda x: re.fullmatch("[0-9]+", x) is not None
        good, _ = structural.whole_numbers(ix, np.arange(ix.first[i], ix.first[i] + ix.count[i]))
        good = bool(len(mine)) and bool(good.all())
        assert good == (bool(want) and all('"' not in w and whole(w) for w in want))


@pytest.mark.parametrize("text,good", [("1", 1), ("-1.5", 1), (".5", 1), ("5.", 1), ("+2e10", 1), ("1E-5", 1), ("1e", 0), (".", 0), ("e5", 0), ("1.2.3", 0), ("inf", 0), ("0x1", 0), ("", 0), ("1" * 100, 1), ("1" * 99 + "x", 0), ("1e999", 1)])
def test_decimals(text, good):
    data = np.frombuffer(text.encode(), np.uint8)
    ix = structural.index(data, np.array([0]), np.array([len(data)]))
    found = structural.decimals(ix, np.arange(len(ix.start)))
    assert (bool(len(found)) and bool(found[0])) == bool(good)


def lines_of(spark, *files):
    rows = [(f, n, x) for f, text in enumerate(files) for n, x in enumerate(text, 1)]
    return spark.createDataFrame(rows, "file_id bigint, line_no bigint, line string")


def test_lines_are_loaded_or_rejected_with_a_reason(spark):
    real, pattern = BANNER.format("real", "general"), BANNER.format("pattern", "symmetric")
    df = lines_of(
        spark,
        [real, "% c", None, "", "2 3 9", "1 1 0.5", ' "2"\t3 "1e3" \r', "1 1", "3 1 1", "1 4 1", "0 1 1", "1 1 x", '1 1 "2', "1 1 1 1", "% end", "\r", "１ 1 1", "1 1 " + "9" * 5000],
        [pattern, "2 2 1", "2 1", "2 1", "1 1", "1 1 3"],
        ["%%MatrixMarket matrix array real general", "1 1 1", "bad"],
        [pattern, "1 1", "1 1", None],
        [pattern, "% only a comment"],
        [None, "1 1 1"],
        [pattern, "99999999999999999999 2 1", "99999999999999999998 1", "1 3"],
    )
    got = {(r.file_id, r.line_no): (r.kind, r.reason, r.e, r.v) for r in load_lines(df).collect()}
    assert len(got) == df.count()
    rejected = {k: v[1] for k, v in got.items() if v[0] == "reject"}
    assert rejected == {
        (0, 3): "line is null", (0, 8): "wrong number of fields", (0, 9): "net is out of range", (0, 10): "vertex is out of range", (0, 11): "net is out of range",
        (0, 12): "value is no finite decimal number", (0, 13): "stray quote", (0, 14): "wrong number of fields", (0, 17): "net is no whole number",
        (1, 6): "wrong number of fields", (2, 1): "banner names another format", (3, 2): "size line needs three whole numbers", (5, 1): "banner is null", (6, 4): "vertex is out of range",
    }
    assert got[0, 7] == ("entry", None, 2, 3) and got[0, 18][0] == "entry" and got[2, 3][0] == "unread" and got[3, 4][0] == "unread"
    pins = sorted((r.file_id, r.net_id, r.vertex_id) for r in loaded_pins(df).where("file_id < 2").collect())
    assert pins == [(0, 0, 0), (0, 1, 2), (1, 0, 0), (1, 0, 1), (1, 1, 0)]


def test_lines_without_place_and_other_columns(spark):
    df = spark.createDataFrame([(None, 1, "x", "a"), (1, None, "y", "b")], "file_id bigint, line_no bigint, line string, reason string")
    assert [r.reason for r in load_lines(df).collect()] == ["row has no place in a file"] * 2
    assert load_lines(df.limit(0)).count() == 0


def test_one_file_holding_most_lines(spark):
    big = [BANNER.format("pattern", "general"), "100 100 1"] + [f"{i % 101} 1" for i in range(5000)]
    df = lines_of(spark, big, *[[BANNER.format("pattern", "general"), "1 1 1", "1 1"]] * 50)
    kinds = {r["kind"]: r["count"] for r in load_lines(df).groupBy("kind").count().collect()}
    assert kinds["header"] == 102 and kinds["reject"] == sum(i % 101 == 0 for i in range(5000)) and kinds["entry"] + kinds["reject"] == 5050


def test_banner():
    assert parse_banner(BANNER.format("real", "general") + "\r") == ("real", "general")
    assert isinstance(parse_banner(BANNER.format("real", "General")), str)
    assert isinstance(parse_banner("﻿" + BANNER.format("real", "general")), str)


def test_reading_files(spark, tmp_path):
    path = tmp_path / "three.mtx"
    path.write_text(THREE)
    h = read_hypergraph(spark, str(path))
    assert h.vertices.count() == 3 and h.pins.count() == 4 and h.nets.count() == 2
    weights = {r[0]: r[1] for r in read_hypergraph(spark, str(path), Weights.DEGREE).vertices.collect()}
    assert weights == {0: 2, 1: 1, 2: 1}
    path.write_text(BANNER.format("integer", "symmetric") + "\n3 3 3\n1 1 5\n2 1 5\n3 2 -1\n")
    assert sorted(map(tuple, read_hypergraph(spark, str(path)).pins.collect())) == [(0, 0), (0, 1), (1, 0), (1, 2), (2, 1)]
    with pytest.raises(MatrixMarketError):
        read_hypergraph(spark, str(tmp_path / "missing.mtx"))
    path.write_text(THREE.replace("3 3 4", "3 3 5"))
    with pytest.raises(MatrixMarketError):
        read_hypergraph(spark, str(path))
    path.write_text(THREE + "4 1\n")
    with pytest.raises(Exception, match="out of range"):
        read_hypergraph(spark, str(path), check_count=False).pins.count()


def test_byte_ranges_split_lines_rightly(spark, tmp_path):
    rng = random.Random(5)
    pins = sorted({(rng.randrange(300), rng.randrange(300)) for _ in range(2000)})
    path = tmp_path / "m.mtx"
    write_matrix(spark.createDataFrame(pins, "net_id bigint, vertex_id bigint"), 300, 300, str(path))
    read_hypergraph(spark, str(path))
    got = spark.read.format("mtx").option("blockbytes", 777).load(str(path))
    assert sorted(map(tuple, got.collect())) == pins


def test_partition_file(spark, tmp_path):
    pins = spark.createDataFrame([(0, 0), (1, 0), (1, 1), (0, 2)], "net_id bigint, vertex_id bigint")
    labels = spark.createDataFrame([(0, 0), (1, 1), (2, 0)], "vertex_id bigint, part bigint")
    path = tmp_path / "out"
    write_partition(pins, labels, 2, 2, 3, path)
    assert path.read_text().splitlines() == ["%%MatrixMarket distributed-matrix coordinate pattern general", "2 3 4 2", "0", "3", "4", "1 1", "2 1", "1 3", "2 2"]


def test_random_pins_are_distinct_and_exact(spark):
    pins = random_pins(spark, 20, 30, 600)
    assert pins.distinct().count() == 600 and random_pins(spark, 7, 9, 10).distinct().count() == 10
    assert random_pins(spark, 3, 3, 0).count() == 0
    with pytest.raises(ValueError):
        random_pins(spark, 2, 2, 5)


def test_options_layers(tmp_path):
    path = tmp_path / "o.toml"
    path.write_text('k = 4\neps = 0.1\nmetric = "cutnet"\n')
    o = Options.load(path, eps=0.2, seed=None)
    assert (o.k, o.eps, o.metric, o.sample_size) == (4, 0.2, Metric.CUT_NET, 10_000)
    (tmp_path / "back.toml").write_text(o.to_toml())
    assert Options.load(tmp_path / "back.toml") == o
    with pytest.raises(ValueError):
        Options.load(kk=3)


def test_command_line(spark, tmp_path):
    matrix, results = tmp_path / "r.mtx", tmp_path / "results"
    main(["generate", "30", "40", "120", str(matrix)])
    main(["partition", str(matrix), "--results", str(results), "--k", "2", "--eps", "0.2", "--lp-max-iter", "3"])
    assert (results / "settings.toml").exists()
    lines = (results / "r.mtx-k2").read_text().splitlines()
    assert lines[1] == "30 40 120 2" and len(lines) == 5 + 120


def test_hypergraph_from_any_two_columns(spark):
    df = spark.createDataFrame([(1, 5, "a"), (1, 5, "b"), (1, 6, None), (None, 6, "c")], "o bigint, p bigint, net_id string")
    h = Hypergraph.from_pairs(df, "o", "p")
    assert h.pins.count() == 2 and sorted(map(tuple, h.vertices.select("vertex_id", "weight").collect())) == [(5, 1), (6, 1)]
