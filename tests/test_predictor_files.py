"""Data sources of predictors' files: the same rows as the readers, however files are cut, and no more than is asked for."""

import gzip
import io
import random

import pytest
from pyspark.sql.datasource import EqualTo, GreaterThan, In, IsNotNull

from epilattice.sources import predictor_files as pf
from epilattice.sources.readers import read_fasta, read_scores, read_wide_mhci, read_wide_mhcii, tidy_scores

EL = "Pos\tPeptide\tID\tcore\ticore\tEL-score\tEL_Rank\tcore\ticore\tEL-score\tEL_Rank\tAve\tNB"
BA = "Pos\tPeptide\tID" + "\tcore\ticore\tEL-score\tEL_Rank\tBA_score\tBA_Rank" * 2
TWO = "Pos\tPeptide\tID\tTarget" + "\tCore\tInverted\tScore_EL\tRank_EL" * 2


@pytest.fixture
def wide(tmp_path):
    def line(i, width, cut=99):
        blocks = [f"c{j}\ti{j}\t" + "\t".join(f"0.{i}{j}{n}" for n in range(width - 2)) for j in range(2)]
        return "\t".join("\t".join([str(i), f"PEPT{'A' * (i % 4)}", "id", *blocks]).split("\t")[:cut])

    el = ["# a remark", "\t\t\tH-2-Db\t\t\t\tHLA-A02:01", EL, *[line(i, 4) for i in range(40)], "", "# more", line(41, 4, 8), line(42, 4, 5), "43\tPEP\tid\tc\ti\tNA\t1d\tc\ti\t 2.5 \t-1e-2"]
    ba = ["\t\t\tH-2-Db\t\t\t\t\t\tH-2-Kb", BA, *[line(i, 6) for i in range(25)], line(30, 6, 11)]
    (tmp_path / "one").mkdir()
    (tmp_path / "one/a.xls").write_text("\n".join(el))  # without a last newline
    (tmp_path / "one/b.xls").write_bytes("\r\n".join([*ba, ""]).encode())
    (tmp_path / "one/c.xls.gz").write_bytes(gzip.compress("\n".join([*ba[:9], ""]).encode()))
    (tmp_path / "one/_SUCCESS").write_text("")
    return str(tmp_path / "one")


def test_pieces_of_any_cut():
    r = random.Random(3)
    for _ in range(300):
        data = bytes(r.choice(b"ab\n") for _ in range(r.randint(0, 30)))
        cuts = sorted({0, 40, *(r.randint(0, 30) for _ in range(3))})
        got = [p for a, b in zip(cuts, cuts[1:]) for p in pf.pieces(io.BytesIO(data), a, b, b"\n")]
        assert got == data.split(b"\n")


def test_pieces_longer_than_a_chunk(monkeypatch):
    monkeypatch.setattr(pf, "CHUNK", 3)
    assert list(pf.pieces(io.BytesIO(b"abcdefgh\n\nxy\nlast"), 0, 99, b"\n")) == [b"abcdefgh", b"", b"xy", b"last"]
    assert list(pf.pieces(io.BytesIO(b"abcdefgh\n\nxy\nlast"), 4, 11, b"\n")) == [b"", b"xy"]


@pytest.mark.parametrize("size", [7, 100, 1 << 20])
def test_wide_mhci(spark, wide, size):
    pf.register_sources(spark)
    rows = spark.read.format("wide_mhci").option("path", wide).option("splitBytes", size).load()
    want = sorted(map(str, read_wide_mhci(spark, wide).collect()))
    assert rows.columns == read_wide_mhci(spark, wide).columns and sorted(map(str, rows.collect())) == want and len(want) > 140


def test_filters_reach_the_source(spark, wide, monkeypatch):
    pf.register_sources(spark)
    spark.sql(f"CREATE OR REPLACE TEMPORARY VIEW wide_files USING wide_mhci OPTIONS (path '{wide}', splitBytes '64')")
    kb = spark.sql("SELECT * FROM wide_files WHERE allele = 'H-2-Kb' AND netMHCpan_EL_rank > 0.1")
    own = read_wide_mhci(spark, wide).where("allele = 'H-2-Kb' AND netMHCpan_EL_rank > 0.1")
    assert sorted(map(str, kb.collect())) == sorted(map(str, own.collect())) and own.count()
    plan = kb._jdf.queryExecution().executedPlan().toString()
    assert "netMHCpan_EL_rank" in plan.split("Filter")[1].split("\n")[0] and "H-2-Kb" not in plan.split("Filter")[1].split("\n")[0]

    reader = pf.WideOneReader(rows_schema(spark, wide), {"path": wide})
    other = GreaterThan(("k",), 3)
    assert list(reader.pushFilters([IsNotNull(("allele",)), EqualTo(("allele",), "HLA-A02:01"), In(("allele",), ("HLA-A02:01", "x")), other])) == [other]
    parsed, opened, number, lines = [], [], pf.number, reader.lines
    monkeypatch.setattr(pf, "number", lambda cell: parsed.append(cell) or number(cell))
    monkeypatch.setattr(reader, "lines", lambda part: opened.append(part.end) or lines(part))
    got = [r for p in reader.partitions() for b in reader.read(p) for r in b.to_pylist()]
    assert {r["allele"] for r in got} == {"HLA-A02:01"} and len(parsed) == 2 * len(got)  # no other allele's cells
    # three heads, and one file's body: the two others name no such allele
    assert len(opened) == 4
    reader.alleles = frozenset()
    assert not [r for p in reader.partitions() for r in reader.rows(p)]


def rows_schema(spark, path):
    return spark.read.format("wide_mhci").option("path", path).load().schema


def test_wide_mhcii(spark, tmp_path):
    pf.register_sources(spark)
    lines = [f"{i}\tPEPTIDES{i}\tid\tNA\tcore{i}\t0\t0.{i}\t{i}.5\tcc\t1\tNA\t7" for i in range(60)]
    (tmp_path / "a.xls").write_text("\n".join(["\t\t\t\tDRB1_0101\t\t\t\tH-2-IAb", TWO, *lines, "61\tSHORT\tid\tNA\tcore\t0\t0.1\t2", ""]))
    want = sorted(map(str, read_wide_mhcii(spark, str(tmp_path)).collect()))
    for size in (50, 5000):
        rows = spark.read.format("wide_mhcii").option("path", str(tmp_path)).option("splitBytes", size).load()
        assert sorted(map(str, rows.collect())) == want and len(want) == 120
    assert rows.where("allele IN ('H-2-IAb', 'none')").count() == 60 and rows.where("allele = 'a' AND allele = 'b'").count() == 0


def test_fasta(spark, tmp_path):
    pf.register_sources(spark)
    text = "".join(f">s{i} of  some\tkind\r\nACDE F\n{'GHIK' * i}\n\n" for i in range(30)) + ">empty\n\n> \nAAA\n>last"
    (tmp_path / "f.fa").write_bytes(text.encode())
    (tmp_path / "g.fa").write_text("")
    want = sorted(map(str, read_fasta(spark, str(tmp_path)).collect()))
    for size in (11, 1 << 20):
        rows = spark.read.format("fasta").option("path", f"file://{tmp_path}").option("splitBytes", size).load()
        assert sorted(map(str, rows.collect())) == want and len(want) == 30


def test_scores(spark, tmp_path):
    pf.register_sources(spark)
    for name, head, row in (("A", "allele\tvariant_id\tVR_mutation\to1\to2", "A\tv{}\t\t0.5\tNA"), ("B", "o2\tVR_mutation\tallele\tvariant_id\tx", "1.5\tG2A\tB\tv{}\tz")):
        for folder in (f"run_{name}", f"run_{name}_combined"):
            (tmp_path / folder).mkdir()
            (tmp_path / folder / "scores.tsv").write_text("\n".join([head, *[row.format(i % 15) for i in range(20)], ""]))
    rows = spark.read.format("allele_scores").options(path=str(tmp_path), outcomes="o1,o2", pathGlobFilter="scores.*", splitBytes="40").load()
    want = sorted(map(str, read_scores(spark, [str(tmp_path)], ["o1", "o2"], "scores.tsv").collect()))
    assert sorted(map(str, tidy_scores(rows, ["o1", "o2"]).collect())) == want and len(want) == 30
    assert {r.allele for r in rows.where("allele = 'B'").collect()} == {"B"}


@pytest.mark.parametrize("kind,text,message", [("wide_mhci", "1\tPEP\tid\n", "no header"), ("wide_mhcii", "\n" + TWO + "\n", "no allele names"), ("allele_scores", "a\tb\n1\t2\n", "no columns")])
def test_files_that_are_none_of_the_kind(spark, tmp_path, kind, text, message):
    pf.register_sources(spark)
    (tmp_path / "f.tsv").write_text(text)
    with pytest.raises(Exception, match=message):
        spark.read.format(kind).option("path", str(tmp_path)).load().collect()


def test_paths(spark, tmp_path):
    pf.register_sources(spark)
    for options, message in (({}, "path is missing"), ({"path": str(tmp_path / "none")}, "none"), ({"path": str(tmp_path)}, "no files")):
        with pytest.raises(Exception, match=message):
            spark.read.format("fasta").options(**options).load().collect()
