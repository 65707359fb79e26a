"""Sequences as column expressions. Bases are upper-case A, C, G, T and N."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BASES = "ACGT"


def reverse_complement(seq: Column) -> Column:
    """Complement of each base in reverse; N stays, anything else but ACGTN becomes A."""
    return F.reverse(F.translate(F.regexp_replace(seq, "[^ACGTN]", "T"), "ACGT", "TGCA"))


def strict_reverse_complement(seq: Column) -> Column:
    """As above, but null if there is a base other than ACGT."""
    return F.when(~seq.rlike("[^ACGT]"), F.reverse(F.translate(seq, "ACGT", "TGCA")))


def original(seq: Column, flag: Column) -> Column:
    """The read as it was sequenced: the reverse complement where flag has 0x10."""
    return F.when(flag.bitwiseAND(16) != 0, reverse_complement(seq)).otherwise(seq)


def flip(pos: Column, n: Column, width: int = 1) -> Column:
    """Position of a motif of ``width`` on the other strand."""
    return n - 1 - (pos + width - 1)


def nibbles(packed: Column, n: Column) -> Column:
    """Text of a BAM sequence: two 4-bit codes a byte, high one first; null if a code is none of A, C, G, T and N."""
    text = F.translate(F.hex(packed), "1248F", "ACGTN")
    return F.when(~F.substr(text, F.lit(1), n).rlike("[^ACGTN]"), F.substr(text, F.lit(1), n))


def one_hot(base: Column) -> Column:
    """Four doubles for A, C, G and T; N is all zeros."""
    return F.array(*[F.when(base == b, 1.0).otherwise(0.0) for b in BASES])


def one_hot_sequence(seq: Column) -> Column:
    return F.flatten(F.transform(F.split(seq, ""), one_hot))


def ordinals(seq: Column) -> Column:
    """A 1, C 2, G 3, T 4, others 0."""
    return F.transform(F.split(seq, ""), lambda b: F.instr(F.lit(BASES), b))


def window_places(n: Column, pos: Column, half: int) -> Column:
    """1-based places pos-half to pos+half of ``n``, the first or last one repeated beyond an end."""
    return F.transform(F.sequence(F.lit(-half), F.lit(half)), lambda d: F.greatest(F.lit(1), F.least(n, pos + d + 1)).cast("int"))


def window(items: Column, pos: Column, half: int) -> Column:
    return F.transform(window_places(F.size(items), pos, half), lambda i: F.element_at(items, i))


def context_kmer(seq: Column, pos: Column, base: Column, half: int) -> Column:
    """The k-mer around ``pos``, reverse complemented for a T."""
    kmer = F.substr(seq, (pos - half + 1).cast("int"), F.lit(2 * half + 1))
    return F.when(base == "T", strict_reverse_complement(kmer)).otherwise(kmer)


def motif_in_centre(kmer: Column, motif: str) -> Column:
    """The centre, as wide as the motif's text, begins with the motif, and no A stands outside of it."""
    width = max(1, len(motif))
    start = ((F.length(kmer) - width) / 2).cast("int")
    centre = F.substr(kmer, start + 1, F.lit(width))
    outside = F.concat(F.substr(kmer, F.lit(1), start), F.substr(kmer, start + width + 1))
    return centre.rlike(f"^(?:{motif or 'A'})") & (F.instr(outside, "A") == 0)


def substitution(ref: Column, alt: Column) -> Column:
    """INS, DEL, or REF->ALT folded to a pyrimidine REF; null for N and for alleles that aren't sequences."""
    change = F.concat(ref, F.lit("->"), alt)
    folded = F.when(ref.isin("A", "G"), F.translate(change, "ACGT", "TGCA")).otherwise(change)
    kind = F.when(F.length(ref) < F.length(alt), "INS").when(F.length(ref) > F.length(alt), "DEL").otherwise(folded)
    return F.when((ref != "N") & (alt != "<*>"), kind)
