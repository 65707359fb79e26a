"""Kinetic signals as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from strandlake.functions.sequence import one_hot, window_places

#: Fixed values of the lossy frame code: from this frame on, codes start here and stand for so many frames.
SEGMENTS = [(0, 0, 1), (64, 64, 2), (192, 128, 4), (448, 192, 8)]
MOST_FRAMES = 952


def encode_frames(raw: Column) -> Column:
    """Code 0 to 255 of a frame count."""
    v = F.least(raw, F.lit(MOST_FRAMES))
    out = v
    for frame, code, step in SEGMENTS[1:]:
        out = F.when(v >= frame, F.lit(code) + F.floor((v - frame) / step)).otherwise(out)
    return out.cast("int")


def decode_frames(code: Column) -> Column:
    """The least frame count of a code."""
    out = code
    for frame, first, step in SEGMENTS[1:]:
        out = F.when(code >= first, F.lit(frame) + (code - first) * step).otherwise(out)
    return out.cast("int")


def scaled(signal: Column) -> Column:
    return F.transform(signal, lambda x: x / F.lit(255.0))


def phred_probability(quality: Column) -> Column:
    """Probability that a base is right, of its quality with the offset of 33."""
    return 1 - F.pow(F.lit(10.0), -(quality - 33) / F.lit(10.0))


def bound(value: Column, f) -> Column:  # noqa: ANN001
    """``f`` of a value that is worked out once, however often ``f`` uses it."""
    return F.get(F.transform(F.array(value), f), 0)


def median(signal: Column) -> Column:
    """Mean of the middle two of an even number; null for none."""
    at = lambda s, i: F.get(s, i.cast("int"))
    return bound(F.sort_array(signal), lambda s: (at(s, F.floor((F.size(s) - 1) / 2)) + at(s, F.floor(F.size(s) / 2))) / F.lit(2.0))


def kmer_features(bases: Column, ipd: Column, pw: Column, pos: Column, k: int) -> Column:
    """[A, C, G, T, ipd/255, pw/255] for each base of the window around ``pos``, one after the other."""
    places = window_places(F.size(bases), pos, k // 2)
    signal = lambda s, i: F.element_at(s, i) / F.lit(255.0)
    return F.flatten(F.transform(places, lambda i: F.concat(one_hot(F.element_at(bases, i)), F.array(signal(ipd, i), signal(pw, i)))))


def context_signal(forward: Column, reverse: Column, pos: Column, base: Column, half: int) -> Column:
    """Around an A the reverse strand's signal at the mirrored place, around a T the forward one's."""
    centre = F.when(base == "A", F.size(reverse) - 1 - pos).otherwise(pos)
    return F.slice(F.when(base == "A", reverse).otherwise(forward), (centre - half + 1).cast("int"), F.lit(2 * half + 1))


def parse_list(text: Column) -> Column:
    """Integers of a list written as text; null if it is none."""
    return F.from_json(text, "array<int>")


def centre(items: Column, k: int, whole: int = 21) -> Column:
    """The middle ``k`` of ``whole`` numbers; zeros where there are none."""
    return F.coalesce(F.slice(items, (whole - k) // 2 + 1, k), F.array_repeat(F.lit(0), k))
