"""Column functions over headers and sequences. All stay in generated JVM code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The accession pattern, the ambiguity codes and the alphabets of the domain.
ACCESSION = r"([A-Z]{1,}[0-9]+(?:\.[0-9]+)?)"
AMBIGUOUS = "RYKMSWBDHV"
DNA, RNA = "ACGTN", "ACGUN"
#: What cleaning leaves as it is: one look instead of three patterns.
PLAIN = r"\A[ACGTN]*+\z"
COMPLEMENT_FROM, COMPLEMENT_TO = "ACGT", "TGCA"


def accession(header: Column) -> Column:
    """The first accession anywhere in a header, or null."""
    return F.nullif(F.regexp_extract(header, ACCESSION, 1), F.lit(""))


def record_id(header: Column) -> Column:
    """The accession, or else the first word; null if there is neither."""
    return F.coalesce(accession(header), F.nullif(F.regexp_extract(header, r"(\S+)", 1), F.lit("")))


def first_token(header: Column) -> Column:
    """What stands before the first space, which is empty for a header that begins with one."""
    return F.split(header, " ", 2)[0]


def split_header(header: Column) -> tuple[Column, Column]:
    """(identifier, description) of a trimmed header; both empty for an empty one."""
    h = F.regexp_replace(header, r"^\s+|\s+$", "")
    return F.regexp_extract(h, r"^(\S+)", 1), F.regexp_extract(h, r"(?s)^\S+\s+(.*)$", 1)


def clean(sequence: Column) -> Column:
    """Upper case, letters only, ambiguity codes as N."""
    other = F.regexp_replace(F.regexp_replace(F.upper(sequence), r"\P{L}", ""), f"[{AMBIGUOUS}]", "N")
    return F.when(sequence.rlike(PLAIN), sequence).otherwise(other)


def alphabet(cleaned: Column, mode: str = "AUTO") -> Column:
    """DNA or RNA; AUTO takes RNA where there is a U and no T."""
    if mode != "AUTO":
        return F.lit(mode)
    return F.when(cleaned.contains("U") & ~cleaned.contains("T"), "RNA").otherwise("DNA")


def normalise(cleaned: Column, kind: Column) -> Column:
    """U and T as the alphabet has them, everything outside it as N."""
    dna = F.when(cleaned.rlike(PLAIN), cleaned).otherwise(F.regexp_replace(F.replace(cleaned, F.lit("U"), F.lit("T")), f"[^{DNA}]", "N"))
    rna = F.regexp_replace(F.replace(cleaned, F.lit("T"), F.lit("U")), f"[^{RNA}]", "N")
    return F.when(kind == "RNA", rna).otherwise(dna)


def count_of(sequence: Column, letters: str) -> Column:
    """How many of the letters a sequence has. Letters are replaced, which is a search for bytes; translate() looks each one up."""
    rest = sequence
    for letter in letters:
        rest = F.replace(rest, F.lit(letter), F.lit(""))
    return (F.length(sequence) - F.length(rest)).cast("long")


def n_frac(length: Column, n_count: Column) -> Column:
    return F.when(length > 0, n_count / length).otherwise(F.lit(1.0))


def gc_percent(sequence: Column, length: Column, n_count: Column) -> Column:
    """Share of G and C among the known bases; among all if none is known; 0 for an empty sequence."""
    known = F.when(length > n_count, length - n_count).otherwise(length)
    return F.when(length > 0, count_of(sequence, "GC") / known * 100).otherwise(F.lit(0.0))


def consensus_n_frac(sequence: Column) -> Column:
    """Unlike n_frac, 0 for an empty sequence."""
    return F.when(F.length(sequence) > 0, count_of(sequence, "N") / F.length(sequence)).otherwise(F.lit(0.0))


def consensus_gc_percent(sequence: Column) -> Column:
    """Unlike gc_percent, over the whole length."""
    return F.when(F.length(sequence) > 0, count_of(sequence, "GC") / F.length(sequence) * 100).otherwise(F.lit(0.0))


def header_organism(header: Column) -> Column:
    """The text after the first space up to a voucher, or UNKNOWN."""
    rest = F.regexp_replace(F.regexp_extract(header, r"(?s)^[^ ]* (.*)$", 1), r"^\s+|\s+$", "")
    cut = F.regexp_replace(F.regexp_replace(rest, r"(?is) voucher.*$", ""), r"^\s+|\s+$", "")
    return F.coalesce(F.nullif(cut, F.lit("")), F.lit("UNKNOWN"))


def kmers(sequence: Column, k: int, ignore_n: bool = True, canonical: bool = False) -> Column:
    """All overlapping k-mers in order, as an array. One look-ahead pass, where a substring for each start would walk
    the text from its beginning."""
    found = F.regexp_extract_all(sequence, F.lit(f"(?=([^N]{{{k}}}))" if ignore_n else f"(?s)(?=(.{{{k}}}))"), F.lit(1))
    return F.transform(found, canonical_form) if canonical else found


def counted(found: Column) -> Column:
    """(kmer, pos) structs of an array of k-mers, sorted, so that equal ones stand together in their order."""
    return F.sort_array(F.transform(found, lambda x, i: F.struct(x.alias("kmer"), i.alias("pos"))))


def run_starts(placed: Column) -> Column:
    """Where the runs of equal k-mers begin in counted()."""
    return F.filter(F.sequence(F.lit(0), F.greatest(F.size(placed) - 1, F.lit(0))), lambda i: (i < F.size(placed)) & ((i == 0) | (placed[i]["kmer"] != placed[F.greatest(i - 1, F.lit(0))]["kmer"])))


def run_counts(placed: Column, starts: Column) -> Column:
    """(kmer, count, first_pos) of each run."""
    return F.transform(starts, lambda i, j: F.struct(placed[i]["kmer"].alias("kmer"), (F.coalesce(F.get(starts, j + 1), F.size(placed)) - i).cast("long").alias("count"), placed[i]["pos"].alias("first_pos")))


def canonical_form(kmer: Column) -> Column:
    """The lesser of a k-mer and its reverse complement."""
    return F.least(kmer, F.reverse(F.translate(kmer, COMPLEMENT_FROM, COMPLEMENT_TO)))


def digest(text: Column) -> Column:
    return F.sha2(F.encode(text, "UTF-8"), 256)


def alignment_key(sequence: Column, program: str, db: str, format_type: str, max_hits: int) -> Column:
    """What cached alignment results are known by."""
    return digest(F.concat_ws("|", F.lit(program), F.lit(db), F.lit(format_type), F.lit(str(max_hits)), sequence))


def query_id(header: Column, number: Column) -> Column:
    """The first word of a header, or query_0001 and so on."""
    word = F.nullif(F.regexp_extract(header, r"(\S+)", 1), F.lit(""))
    return F.when(F.length(header) > 0, word).otherwise(F.format_string("query_%04d", number))


def safe_name(text: Column, most: int = 100, fallback: str = "query") -> Column:
    """Letters, digits, - and _ as they are, the rest as _."""
    cut = F.substring(F.regexp_replace(text, r"[^\p{L}\p{N}_-]", "_"), 1, most)
    return F.when(F.length(cut) > 0, cut).otherwise(F.lit(fallback)) if fallback else cut


def jaccard(shared: Column, size_a: Column, size_b: Column) -> Column:
    """Similarity of two sets from their overlap; 1 for two empty ones."""
    union = size_a + size_b - shared
    return F.when(union > 0, shared / union).otherwise(F.lit(1.0))


def tf(count: Column, total: Column) -> Column:
    return F.when(total > 0, count / total).otherwise(F.lit(0.0))


def idf(records: Column, holding: Column) -> Column:
    return F.when(records > 0, F.log((records + 1) / (holding + 1))).otherwise(F.lit(0.0))
