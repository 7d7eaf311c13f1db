"""Column functions over sequences, qualities, headers and FASTQ records."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Complements; every other character stands for itself.
_BASES, _COMPLEMENTS = "ACGTNacgtn", "TGCANtgcan"


def complement_reversed(seq: Column) -> Column:
    """The reverse complement."""
    return F.reverse(F.translate(seq, _BASES, _COMPLEMENTS))


def reversed_text(text: Column) -> Column:
    return F.reverse(text)


def scores(qual: Column) -> Column:
    """Phred scores (offset 33) of a quality string; none for the empty one."""
    letters = F.when(F.length(qual) > 0, F.split(qual, "")).otherwise(F.when(qual.isNotNull(), F.array().cast("array<string>")))
    return F.transform(letters, lambda c: F.ascii(c) - 33)


#: What the reader's ``phred`` option may ask for.
PHRED = {"illumina": scores, "raw": lambda qual: qual}


def phred(kind: str):
    """The quality function of that name; ValueError for an unknown one."""
    if kind not in PHRED:
        raise ValueError(f"unknown kind of quality score: {kind!r}")
    return PHRED[kind]


def control_id(header: Column) -> Column:
    """The header's first word, null where there is none."""
    word = F.regexp_extract(header, r"(\S+)", 1)
    return F.when(word != "", word)


def same_read(header: Column, other_id: Column, strict: bool = False) -> Column:
    """Whether ``header`` belongs with a mate of the given id: it begins with
    it, or with ``strict`` has that very id."""
    return control_id(header) == other_id if strict else header.startswith(other_id)


def cut(text: Column, start: Column, end: Column) -> Column:
    """Characters ``start`` to ``end`` (0-based, half open)."""
    return F.substring(text, start + 1, F.greatest(end - start, F.lit(0)))


def remainder(text: Column, start: Column, end: Column, joint: str = "----") -> Column:
    """What is left around the cut, joined by dashes."""
    return F.concat(cut(text, F.lit(0), start), F.lit(joint), F.substring(text, end + 1, F.length(text)))


def tag_array(tags: Sequence[tuple[str, Column]]) -> Column:
    """An ordered array of (k, v); a null value means the tag is left out."""
    return F.array(*[F.struct(F.lit(k).alias("k"), v.alias("v")) for k, v in tags])


def tagged_header(header: Column, tags: Column) -> Column:
    """The header followed by `` k=v`` for each tag with a value."""
    kept = F.transform(F.filter(tags, lambda t: t["v"].isNotNull()), lambda t: F.concat(t["k"], F.lit("="), t["v"]))
    return F.array_join(F.concat(F.array(header), kept), " ")


def fastq_record(header: Column, seq: Column, qual: Column) -> Column:
    """The four lines of a record; null parts are empty lines."""
    empty = F.lit("")
    return F.concat_ws("\n", F.coalesce(header, empty), F.coalesce(seq, empty), F.lit("+"), F.coalesce(qual, empty))


def sam_line(line: Column, comments: Sequence[str] | str, tags: Sequence[str] | str, token_bound: bool = False) -> Column:
    """A SAM line whose comment's ``CB=...`` entries become proper tags.

    The comment is the last tab-separated field, and stays. For each prefix in
    turn the first place it occurs gives a tag, put before the comment; its
    value ends at white space and may be empty. Header lines and those without
    any prefix stay, stripped. By default a prefix may stand inside a word;
    with ``token_bound`` only at a word's beginning.
    """
    comments = [comments] if isinstance(comments, str) else list(comments)
    tags = [tags] if isinstance(tags, str) else list(tags)
    if len(comments) != len(tags):
        raise AssertionError("as many tag prefixes as comment prefixes are needed")

    def tagged(text: Column) -> Column:
        comment = F.substring_index(text, "\t", -1)
        made = []
        for prefix, tag in zip(comments, tags):
            found = (r"(?:\A|(?<=\s))" if token_bound else "") + r"\Q" + prefix + r"\E"
            there = comment.rlike(found) if token_bound else comment.contains(prefix)
            # A value never starts after a blank: "UB= x" is an empty tag.
            made.append(F.when(there, F.concat(F.lit(tag), F.regexp_extract(comment, found + r"(?: |\s*(\S*))", 1), F.lit("\t"))).otherwise(""))
        head = F.substring(text, F.lit(1), F.length(text) - F.length(comment))
        return F.when(text.startswith("@"), text).otherwise(F.concat(head, *made, comment))

    # Bound to a variable, the stripped line is made once, not for each use.
    return F.transform(F.array(F.regexp_replace(line, r"\A\s+|\s+\z", "")), tagged)[0]


SAM_COMMENTS = ["CB=", "CR=", "CY=", "UB=", "UR=", "UY="]
SAM_TAGS = ["CB:Z:", "CR:Z:", "CY:Z:", "UB:Z:", "UR:Z:", "UY:Z:"]
