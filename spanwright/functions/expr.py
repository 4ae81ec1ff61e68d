"""Scalar functions over annotated intervals and sequences, all native column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Complements of bases.
BASES, COMPLEMENTS = "ACGTNacgtn", "TGCANtgcan"
TIERS = (0.3, 0.7, 1.0)
MIN_LEN, MAX_LEN = 4, 20


def _column(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def attr_map(attrs: Column | str) -> Column:
    """Attributes ``a=1;b=2`` as a map: items without ``=`` are left out, the last of a key wins."""
    items = F.filter(F.transform(F.split(_column(attrs), ";"), lambda x: F.trim(x)), lambda x: F.contains(x, F.lit("=")))
    return F.map_from_entries(F.transform(items, lambda x: F.struct(F.substring_index(x, "=", 1), F.substr(x, F.instr(x, "=") + 1))))


def type_counts(bag: Column | str) -> Column:
    """Counts ``a:2,b`` as a map: a count that is none is 1, repeats are added up, blank items left out."""
    items = F.filter(F.transform(F.split(_column(bag), ","), lambda x: F.trim(x)), lambda x: F.length(x) > 0)
    pairs = F.transform(items, lambda x: F.struct(F.trim(F.substring_index(x, ":", 1)).alias("k"), F.coalesce(F.trim(F.get(F.split(x, ":", 2), F.lit(1))).try_cast("int"), F.lit(1)).alias("n")))
    empty = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<int>"))
    add = lambda acc, p: F.map_concat(acc, F.create_map(p["k"], F.coalesce(F.element_at(acc, p["k"]), F.lit(0)) + p["n"]))
    return F.aggregate(F.coalesce(pairs, F.array().cast("array<struct<k:string,n:int>>")), empty, add)


def type_count(counts: Column, name: str) -> Column:
    return F.coalesce(F.element_at(counts, F.lit(name)), F.lit(0))


def total_count(counts: Column) -> Column:
    return F.aggregate(F.map_values(counts), F.lit(0), lambda a, n: a + n)


def header_attrs(header: Column | str) -> Column:
    """Attributes of a sequence header, parted by semicolons or blanks; keys are lower-cased, the last wins."""
    items = F.filter(F.split(F.ltrim(F.regexp_replace(_column(header), "^>+", "")), r"[;\s]+"), lambda x: F.contains(x, F.lit("=")))
    return F.map_from_entries(F.transform(items, lambda x: F.struct(F.trim(F.lower(F.substring_index(x, "=", 1))), F.trim(F.substr(x, F.instr(x, "=") + 1)))))


def header_type_fields(header: Column | str) -> tuple[Column, Column]:
    """The ``mge`` and ``mge_type`` values of a lower-cased header; empty where missing."""
    low = F.lower(_column(header))
    return F.regexp_extract(low, r"(?:^|[>;\s])mge=([^;\s]+)", 1), F.regexp_extract(low, r"(?:^|[>;\s])mge_type=([^;\s]+)", 1)


def accession_of(mge_id: Column | str) -> Column:
    """``GCA_<n>`` of an element id; null for other ids."""
    p = F.split(_column(mge_id), "_")
    return F.when((F.get(p, F.lit(1)) == "GCA") & (F.size(p) > 2), F.concat_ws("_", F.get(p, F.lit(1)), F.get(p, F.lit(2))))


def genome_key_of_id(mge_id: Column | str) -> Column:
    """``taxid.sample`` of an element id; null where there is none."""
    p = F.split(F.get(F.split(_column(mge_id), "_"), F.lit(3)), r"\.")
    return F.when((F.size(p) >= 2) & F.get(p, F.lit(0)).rlike("^[0-9]+$"), F.concat_ws(".", F.get(p, F.lit(0)), F.get(p, F.lit(1))))


def genome_key_of_contig(contig: Column | str, keep_case: bool = False) -> Column:
    name = _column(contig) if keep_case else F.lower(_column(contig))
    return F.substring_index(name, ".", 2)


def revcomp(seq: Column | str) -> Column:
    """The reverse complement; characters that are no bases stay."""
    return F.reverse(F.translate(_column(seq), BASES, COMPLEMENTS))


def interval_substring(seq: Column | str, start: Column, end: Column) -> Column:
    """The bases from start to end, both counted from 1 and included; cut at the sequence's end."""
    return F.substr(_column(seq), start.cast("int"), F.greatest(F.lit(0), end - start + 1).cast("int"))


def slice0(seq: Column | str, start: Column, end: Column) -> Column:
    """The bases from start up to end, counted from 0; never from behind."""
    return F.substr(_column(seq), (F.greatest(start, F.lit(0)) + 1).cast("int"), F.greatest(F.lit(0), end - F.greatest(start, F.lit(0))).cast("int"))


def flank_windows(start: Column, end: Column, length: Column, flank: int, overlap: int) -> tuple[Column, Column, Column, Column]:
    """Starts and ends, counted from 0, of the left and the right window at an interval's ends."""
    inner = start - 1 + overlap
    outer = F.greatest(F.lit(0), end - overlap)
    return F.greatest(F.lit(0), inner - flank), F.least(inner, length), outer, F.least(length, end - overlap + flank)


def orient_flanks(left: Column, right: Column, sign: Column) -> tuple[Column, Column]:
    """Windows as they stand on the other strand if the sign is ``+``: swapped and complemented."""
    return F.when(sign == "+", revcomp(right)).otherwise(left), F.when(sign == "+", revcomp(left)).otherwise(right)


def orient_body(body: Column, sign: Column) -> Column:
    """The element itself as it stands on the other strand if the sign is ``+``."""
    return F.when(sign == "+", revcomp(body)).otherwise(body)


def strip_overlap(seq: Column | str, side: Column | str, n: int) -> Column:
    """A window without the ``n`` bases inside the element: the last ones left, the first ones right."""
    seq, size = _column(seq), F.length(_column(seq))
    if n <= 0:
        return seq
    cut = F.when(_column(side) == "left", F.substr(seq, F.lit(1), size - n)).otherwise(F.substr(seq, F.lit(n + 1)))
    return F.when(size <= n, F.lit("")).otherwise(cut)


def anchor(seq: Column | str, side: Column | str, n: int, side_aware: bool = True) -> Column:
    """The ``n`` bases inside the element."""
    first = F.left(_column(seq), F.lit(n))
    return F.when(_column(side) == "left", F.right(_column(seq), F.lit(n))).otherwise(first) if side_aware else first


def motif_match(seq: Column | str, pattern: str) -> Column:
    """Whether a pattern occurs on either strand; its capitals but N must match, all else is any base."""
    rx = "".join(c if c.isupper() and c != "N" else "." for c in pattern)
    up = F.upper(_column(seq))
    return up.rlike(rx) | F.reverse(F.translate(up, "ACGTN", "TGCAN")).rlike(rx)


def group_dir(group: Column, singleton: Column) -> Column:
    none = (singleton == "yes") | group.isNull() | group.cast("string").isin("", "NA")
    return F.when(F.coalesce(none, F.lit(True)), F.lit("singleton")).otherwise(F.concat(F.lit("duplicate_group_"), group.cast("string")))


def variant_matches(mge_type: Column, variant: str) -> Column:
    """Elements of a variant: merged (all), nested or non_nested."""
    return F.lit(True) if variant == "merged" else mge_type == variant.replace("_", "-")


def rec_type_subset(column: Column, names: str | None) -> Column:
    """Rows of the named types; of all if no names or ``all`` are given."""
    if not names or names.strip().lower() == "all":
        return F.lit(True)
    return column.isin([n.strip() for n in names.split(",") if n.strip()])


def dynamic_threshold(n: Column, small: float, large: float, cutoff: int) -> Column:
    return F.when(n <= cutoff, F.lit(small)).otherwise(F.lit(large))


def dynamic_run_len(n: Column, run: int, cutoff: int) -> Column:
    return F.when(n <= cutoff, F.lit(1)).otherwise(F.lit(run))


def resolve_species(speci: Column, mge_id: Column) -> Column:
    """The species, else a stand-in by accession, else one by id."""
    gca = accession_of(mge_id)
    return F.coalesce(speci, F.concat(F.lit("__unresolved_gca__:"), gca), F.concat(F.lit("__unresolved_id__:"), mge_id))


def nearest_tier(x: Column, tiers: tuple[float, ...] = TIERS) -> Column:
    """The closest tier, the earlier one of two."""
    return F.array_min(F.array(*(F.struct(F.abs(x - t).alias("d"), F.lit(i).alias("i"), F.lit(t).alias("t")) for i, t in enumerate(tiers))))["t"]


def one_hot(seq: Column | str, length: int) -> Column:
    """Four rows of 0 and 1 by A, C, G, T; cut or padded to a length."""
    at = F.sequence(F.lit(1), F.lit(length))
    return F.transform(F.array(*map(F.lit, "ACGT")), lambda b: F.transform(at, lambda i: F.when(F.substr(_column(seq), i, F.lit(1)) == b, 1.0).otherwise(0.0).cast("float")))


def model_orientation(seq: Column | str, side: Column | str) -> Column:
    up = F.upper(_column(seq))
    return F.when(_column(side) == "left", revcomp(up)).otherwise(up)


def flip_segment(start: Column, length: Column, size: Column, side: Column) -> Column:
    """A segment's start in the model's orientation."""
    return F.when(side == "left", size - (start + length)).otherwise(start)


def score_magnitude(a: Column, c: Column, g: Column, t: Column) -> Column:
    return F.abs(a) + F.abs(c) + F.abs(g) + F.abs(t)


def soft_label(found: Column, matched: Column) -> Column:
    return F.when(found & matched, 1.0).when(found, 0.7).otherwise(0.3)


def label_reason(windows: Column, stripped: Column, found: Column, matched: Column, is_open: Column) -> Column:
    """Why a side has its label: what was missing, or what kind of segment was found and whether a motif matched.

    ``windows`` and ``stripped`` tell whether there were windows, and any bases outside the overlap.
    """
    source = F.when(is_open, "trailing_at_boundary").otherwise("closed_segment")
    why = F.when(matched, F.concat(F.lit("found_literature_match_"), source)).otherwise(F.concat(F.lit("found_no_literature_match_"), source))
    missing = F.when(~windows, "no_alignment_file").when(~stripped, "no_sequence_outside_overlap").otherwise("no_segment_in_length_bucket")
    return F.when(found & windows & stripped, why).otherwise(missing)


def length_bucket(n: Column) -> Column:
    """Evaluation's buckets: lengths 4 and 20 are in none."""
    return F.when(n < 4, "under_4").when((n > 4) & (n < 20), "4_to_20").when(n > 20, "over_20")


def render_map(m: Column) -> Column:
    """A map as sorted text ``k=v;k=v``."""
    return F.array_join(F.array_sort(F.transform(F.map_entries(m), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string")))), ";")
