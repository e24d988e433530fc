import pytest
from pyspark.sql import functions as F

from epilattice.operators.fragments import count_stops, counted_peptides, drop_stops, fragment, numbered_peptides, peptide_map, unique_peptides
from epilattice.operators.predictions import ordered_distinct, peptide_allele_pairs, peptides_of
from epilattice.sources.readers import clean_library, read_fasta, read_library, read_peptide_map, read_table, read_unique_peptides
from epilattice.sources.writers import write_fragment_tables, write_pair_input, write_peptide_lists


def lib(spark, *rows):
    return spark.createDataFrame(rows, "variant_id string, aa_sequence string")


def cuts(df):
    return sorted((r.start, r.peptide) for r in df.collect())


def test_windows(spark):
    assert cuts(fragment(lib(spark, ("v", "ABCDE")), [3])) == [(1, "ABC"), (2, "BCD"), (3, "CDE")]
    assert cuts(fragment(lib(spark, ("v", "AB"), ("w", "")), [3])) == []
    with pytest.raises(ValueError):
        fragment(lib(spark, ("v", "AB")), [0])


def test_many_windows_and_repeated_k(spark):
    rows = lib(spark, *[(f"v{i}", "ABCDEFGHIJ") for i in range(50)])
    out = fragment(rows, [3, 4])
    assert out.count() == 750 and unique_peptides(out).agg(F.sum("occurrence_count")).first()[0] == 750
    assert fragment(rows, [3, 3]).count() == 800


def test_long_sequence_is_cut_in_pieces(spark):
    text = "".join(chr(65 + i * i % 26) for i in range(1000))
    out = cuts(fragment(lib(spark, ("v", text)), [5]))
    assert out == sorted((i + 1, text[i : i + 5]) for i in range(996))


def test_region(spark):
    one = lib(spark, ("v", "ABCDEFG"))
    assert [s for s, _ in cuts(fragment(one, [3], (4, 4), "overlap"))] == [2, 3, 4]
    assert [s for s, _ in cuts(fragment(one, [3], (3, 6), "contained"))] == [3, 4]
    assert cuts(fragment(one, [3], (1, 1), "contained")) == []
    for bad in (((5, 4), "overlap"), ((1, 2), "near"), (None, "overlap")):
        with pytest.raises(ValueError):
            fragment(one, [3], *bad)


@pytest.mark.parametrize("mode", ["overlap", "contained"])
def test_bounded_generation_equals_a_filter(spark, mode):
    rows = lib(spark, *[(str(n), "ACDEFGHIKLMNPQRSTVWY"[:n]) for n in range(1, 20)])
    keep = F.expr("NOT (`end` < 6 OR start > 11)" if mode == "overlap" else "start >= 6 AND `end` <= 11")
    for k in (1, 4, 9):
        a = fragment(rows, [k], (6, 11), mode)
        assert sorted(map(tuple, a.collect())) == sorted(map(tuple, fragment(rows, [k]).where(keep).collect()))


def test_stops(spark):
    rows = lib(spark, ("a", "AB*DE"), ("b", "*BCDE"), ("c", "ABCDE"))
    assert {r.variant_id for r in drop_stops(rows, (2, 4)).collect()} == {"b", "c"}
    assert tuple(count_stops(rows, (2, 4)).first()) == (3, 1, 2)


def test_numbers_follow_first_appearance(spark):
    rows = spark.createDataFrame([(2, "b", "XABC"), (1, "a", "ABCX")], "row long, variant_id string, aa_sequence string")
    out = numbered_peptides(fragment(rows, [3]), ["row"], [3])
    assert [(r.peptide_id, r.peptide, r.occurrence_count) for r in out.orderBy("peptide_id").collect()] == [
        ("pep_000001", "ABC", 2), ("pep_000002", "BCX", 1), ("pep_000003", "XAB", 1)
    ]
    assert peptide_map(fragment(rows, [3]), out).count() == 4


def test_library_and_fasta(spark, tmp_path):
    (tmp_path / "l.csv").write_text('gene_id,seq,"odd""name"\n v1 , A B C ,m\nv2,,m\n,ABC,m\nNA,ABC,\n')
    out = read_library(spark, str(tmp_path / "l.csv"), "gene_id", "seq", ['odd"name'])
    assert sorted(map(tuple, out.collect())) == [("NA", "ABC", ""), ("v1", "ABC", "m")]
    with pytest.raises(ValueError):
        read_library(spark, str(tmp_path / "l.csv"), "gene_id", "absent")
    (tmp_path / "f.fa").write_text(">s1 first one\nAB C\nDEF\n\n>s2\nGHI\n")
    assert sorted(map(tuple, read_fasta(spark, str(tmp_path / "f.fa")).collect())) == [("s1", "s1 first one", "ABCDEF"), ("s2", "s2", "GHI")]
    assert clean_library(spark.createDataFrame([(None, "A")], "a string, b string"), "a", "b").count() == 0


def test_tables_round_trip(spark, tmp_path):
    rows = lib(spark, ("v", "ABCDE"), ("w", "ABCDF"))
    own = fragment(rows, [3])
    ids = unique_peptides(own).withColumn("peptide_id", F.concat(F.lit("p"), "peptide"))
    for _ in range(2):  # the second run replaces the first
        write_fragment_tables(own, ids, peptide_map(own, ids), str(tmp_path / "t"), "tsv")
    back = read_unique_peptides(spark, str(tmp_path / "t/unique_peptides"), strict=True)
    assert sorted(map(tuple, back.select("peptide", "k", "occurrence_count").collect())) == sorted(map(tuple, ids.select("peptide", "k", "occurrence_count").collect()))
    assert read_peptide_map(spark, str(tmp_path / "t/peptide_map")).count() == 6
    write_pair_input(ids, ["x", "y", "x"], str(tmp_path / "pairs"))
    assert read_table(spark, str(tmp_path / "pairs"), ["allele", "peptide"], ",").count() == 8
    write_peptide_lists(ids, str(tmp_path / "lists"))
    assert spark.read.text(str(tmp_path / "lists")).count() == 4


def test_peptides_and_pairs(spark):
    p = spark.createDataFrame([(" AB ", 2), ("AB", 2), (" ", 2), ("ABC", 3), (None, 2)], "peptide string, k int")
    assert [r[0] for r in peptides_of(p, 2).collect()] == ["AB"]
    assert peptide_allele_pairs(p, ["a", "b", "a"]).count() == 4
    assert ordered_distinct([3, 1, 3]) == [3, 1]


def test_streaming_input(spark, tmp_path):
    lib(spark, ("v", "ABCDE"), ("w", "AB*DE")).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("variant_id string, aa_sequence string").parquet(str(tmp_path / "in"))
    query = fragment(drop_stops(stream, (2, 4)), [3]).writeStream.format("memory").queryName("cuts").trigger(availableNow=True).start()
    query.awaitTermination(60)
    assert spark.table("cuts").count() == 3


def test_same_result_for_any_number_of_partitions(spark):
    rows = lib(spark, *[(str(i), "ACDEFGHIKL"[i % 5 :]) for i in range(60)])
    out = []
    for n in (1, 8):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        out.append(sorted(map(tuple, unique_peptides(fragment(rows.repartition(n), [4])).collect())))
    spark.conf.set("spark.sql.shuffle.partitions", 4)
    assert out[0] == out[1]


@pytest.mark.parametrize("mode", [None, "overlap", "contained"])
def test_windows_counted_in_tasks(spark, mode):
    """The same counts as from rows of windows; short, empty and missing sequences, a k listed twice, characters beyond ASCII."""
    rows = [("a", "ABCDEFGABCDEFG" * 3), ("b", "ABC"), ("c", ""), ("d", None), ("e", "äöü€𝄞" * 5), ("f", "ABCDEFGH")]
    library = spark.createDataFrame(rows, "variant_id string, aa_sequence string")
    for kmers in ([3], [2, 4], [3, 3]):
        want = {(r.peptide, r.k): r.occurrence_count for r in unique_peptides(fragment(library, kmers, (4, 6), mode)).collect()}
        got = [(r.peptide, r.k, r.occurrence_count) for r in counted_peptides(library, kmers, (4, 6), mode).collect()]
        assert {(p, k): n for p, k, n in got} == want and len(got) == len(want)
    with pytest.raises(ValueError):
        counted_peptides(library, [0])
