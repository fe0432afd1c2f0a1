import random

from pyspark.sql import functions as F

from helixframe import sinks
from helixframe.functions import sequences as S
from helixframe.sources import fasta

TRICKY = "junk before\nmore\n>A1 first a>b\nACGT\n\n  acgt  \nA C\r\n> b c\r\nUU\r\nGG\r\n>empty\n>last\nNNN"


def rows(df):
    return [tuple(r) for r in df.orderBy("idx").collect()]


def test_records_lines_and_order(spark, tmp_path):
    (tmp_path / "a.fasta").write_bytes(TRICKY.encode())
    got = rows(fasta.read_fasta(spark, f"file://{tmp_path}/a.fasta"))
    assert got == [(0, "A1 first a>b", "ACGTacgtA C"), (1, " b c", "UUGG"), (2, "empty", ""), (3, "last", "NNN")]


def test_first_record_at_the_start_and_files_in_order(spark, tmp_path):
    (tmp_path / "b.fasta").write_text(">x\nA\n>y\nC\n")
    (tmp_path / "a.fasta").write_text(">w\nG\n")
    (tmp_path / "c.fasta").write_text("")
    got = rows(fasta.read_fasta(spark, f"file://{tmp_path}"))
    assert [g[1] for g in got] == ["w", "x", "y"] and [g[0] for g in got] == [0, 1, 2]


def test_a_file_of_many_splits_keeps_its_order(spark, tmp_path):
    (tmp_path / "big.fasta").write_text("".join(f">r{i}\n{'ACGT' * (i % 7)}\n" for i in range(5000)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "10000")
    try:
        got = rows(fasta.read_fasta(spark, f"file://{tmp_path}/big.fasta"))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert [(g[0], g[1], g[2]) for g in got] == [(i, f"r{i}", "ACGT" * (i % 7)) for i in range(5000)]


def test_headers_after_white_space(spark, tmp_path):
    (tmp_path / "i.fasta").write_text("  >a\nAC\n\t>b\nGT\n")
    assert [r[1:] for r in rows(fasta.read_fasta(spark, f"file://{tmp_path}/i.fasta"))] == [("a", "AC"), ("b", "GT")]
    (tmp_path / "j.fasta").write_bytes(b"before\r\n >a x\r\nACGT\r\n   >b y\r\nGGTT\r\n>c\r\nA\r\n\t >d\r\n\r\n >e\nC > G\n")
    assert rows(fasta.read_fasta(spark, f"file://{tmp_path}/j.fasta")) == [(0, "a x", "ACGT"), (1, "b y", "GGTT"), (2, "c", "A"), (3, "d", ""), (4, "e", "C > G")]
    assert [r[3] for r in rows(fasta.read_records(spark, f"file://{tmp_path}/j.fasta"))] == ["BEFOREACGT", "GGTT", "A", "", "C > G"]


def test_headers_after_white_space_in_many_splits(spark, tmp_path):
    (tmp_path / "big.fasta").write_text("lead\n" + "".join(f"{' ' * (i % 3)}>r{i}\n{'ACGT' * (i % 7)}\n" for i in range(3000)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "5000")
    try:
        got, own = rows(fasta.read_fasta(spark, f"file://{tmp_path}/big.fasta")), rows(fasta.read_records(spark, f"file://{tmp_path}/big.fasta"))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert got == [(i, f"r{i}", "ACGT" * (i % 7)) for i in range(3000)]
    assert [(r[0], r[1], r[3]) for r in own] == [(i, f"r{i}", "LEAD" * (i == 0) + "ACGT" * (i % 7)) for i in range(3000)]


def reference_records(text):
    """(header, sequence) by lines, as the reference reads them."""
    out = []
    for line in text.replace("\r\n", "\n").replace("\r", "\n").split("\n"):
        line = line.strip()
        if line.startswith(">"):
            out.append([line[1:], ""])
        elif out:
            out[-1][1] += line
    return [(i, *r) for i, r in enumerate(out)]


def test_indented_headers_are_read_by_many_tasks(spark, tmp_path):
    """A file of which no line begins with > was one row of one task."""
    (tmp_path / "big.fasta").write_text("lead\n" + "".join(f" \t>r{i}\n{'ACGT' * 20}\n" for i in range(2000)))
    before = {c: spark.conf.get(c) for c in ("spark.sql.files.maxPartitionBytes", "spark.sql.adaptive.enabled")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        got = fasta.read_fasta(spark, f"file://{tmp_path}/big.fasta")
        assert rows(got) == [(i, f"r{i}", "ACGT" * 20) for i in range(2000)]
        assert got.select(F.spark_partition_id()).distinct().count() > 1
    finally:
        for c, v in before.items():
            spark.conf.set(c, v)


def test_odd_marks_over_splits_of_any_size(spark, tmp_path):
    rng = random.Random(3)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for _ in range(3):
            text = "".join(rng.choice([">", ">", " ", "\n", "\n", "\r\n", "\t>", "\n>", "A", "CG", "\n >", "x"]) for _ in range(rng.choice([3, 40, 150])))
            (tmp_path / "odd.fasta").write_bytes(text.encode())
            for size in ("7", "31"):
                spark.conf.set("spark.sql.files.maxPartitionBytes", size)
                assert rows(fasta.read_fasta(spark, f"file://{tmp_path}/odd.fasta")) == reference_records(text), (text, size)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_second_dialect(spark, tmp_path):
    (tmp_path / "r.fasta").write_text("AA\n>seq1 description here\nacgt\ntgca\n> b  c\nUUuu\n>\nA\n")
    got = rows(fasta.read_records(spark, f"file://{tmp_path}/r.fasta", convert_u_to_t=True))
    # lines before the first header open its sequence
    assert got == [(0, "seq1", "description here", "AAACGTTGCA"), (1, "b", "c", "TTTT"), (2, "", "", "A")]
    raw = rows(fasta.read_records(spark, f"file://{tmp_path}/r.fasta", uppercase=False))
    assert raw[1][3] == "UUuu"


def test_written_records_read_the_same(spark, tmp_path):
    df = spark.createDataFrame([(0, "a b", "ACGT" * 50), (1, "c", ""), (2, "d", "A" * 80)], "idx long, header string, sequence string")
    path = sinks.write_fasta(df, tmp_path / "out.fasta", F.col("header"))
    text = path.read_text()
    assert max(map(len, text.splitlines())) == 80 and ">c\n>d\n" in text
    assert rows(fasta.read_fasta(spark, f"file://{path}")) == rows(df)
    assert [p.name for p in tmp_path.iterdir()] == ["out.fasta"]


def test_split_header(spark):
    i, d = S.split_header(F.col("h"))
    got = spark.createDataFrame([("",), ("a",), (" a  b c ",)], "h string").select(i, d).collect()
    assert [tuple(g) for g in got] == [("", ""), ("a", ""), ("a", "b c")]
