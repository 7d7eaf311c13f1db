"""Loading delimited lines while setting aside those that fail to parse.

A :class:`LineSchema` names the fields of a line in order, each with the regular
expression its value has to match. From it one anchored expression for whole
lines is generated. Lines that match it and pass the cross-field checks are
valid. The others go through a ladder of growing prefix patterns (field 1,
fields 1-2, ...), and the first rung that fails names the broken field.

Everything is a Catalyst expression over the line: no Python worker, no
shuffle, one pass. The repeated groups are possessive, which Java's engine runs
as a loop, so a field of a million doubled quotes needs no stack.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from readroute.session import col, fresh

#: Field values in Java's syntax: blanks are those of Unicode, digits of ASCII.
BLANK = r"\p{IsWhite_Space}"


@dataclass(frozen=True)
class LineField:
    """One field of a line.

    ``plain`` matches the whole value where it stands without quotes (it must
    admit neither quote nor separator), ``quoted`` the raw text between the
    enclosing quotes, in which a quote is written twice.
    """

    name: str
    plain: str
    quoted: str


@dataclass(frozen=True)
class LineSchema:
    fields: tuple[LineField, ...]
    #: (reason, function of the parsed field columns giving true where it holds)
    checks: tuple = field(default=())

    def value(self, f: LineField) -> str:
        return f'(?:"(?:{f.quoted})"|(?:{f.plain}))'

    def line_pattern(self) -> str:
        return r"\A" + ",".join(f'("(?:{f.quoted})"|(?:{f.plain}))' for f in self.fields) + r"\z"

    #: Any field whatever its value: quoted text, or text without a quote.
    ANY = r'(?:"(?:[^"]++|"")*+"|[^",]*+)'

    def shape_pattern(self, n: int) -> str:
        """The first ``n`` fields are well formed as far as quoting goes."""
        return r"\A" + ",".join([self.ANY] * n) + r"(?:,|\z)"

    def prefix_pattern(self, n: int) -> str:
        """The first ``n`` fields hold valid values."""
        return r"\A" + ",".join(self.value(f) for f in self.fields[:n]) + r"(?:,|\z)"


FASTQ_LINE = LineSchema(
    fields=(
        LineField("rec_pos", r"[0-9]{1,18}+", r"[0-9]{1,18}+"),
        LineField("header", rf'@[^{BLANK}",][^",]*+', rf'@(?:[^{BLANK}"]|"")(?:[^"]++|"")*+'),
        LineField("seq", r"[ACGTNacgtn]++", r"[ACGTNacgtn]++"),
        LineField("qual", r"[!#-+\--~]++", r'(?:[!#-~]++|"")++'),
    ),
    checks=(("qual_length", lambda c: F.length(c["qual"]) == F.length(c["seq"])),),
)


def _unquoted(raw: Column) -> Column:
    inner = F.substring(raw, F.lit(2), F.length(raw) - 2)
    return F.when(raw.startswith('"'), F.replace(inner, F.lit('""'), F.lit('"'))).otherwise(raw)


def parse_lines(df: DataFrame, line: str, schema: LineSchema = FASTQ_LINE, reason: str = "reason", parsed: str = "record") -> DataFrame:
    """Add the parsed record and the reason for failure to every row of ``df``.

    ``parsed`` is a struct of the fields' strings, null where the line is no
    record; ``reason`` is null exactly where the line is valid, else one of

    - ``null_line``: no line at all;
    - ``quoting:<field>``: the quoting of that field is broken;
    - ``missing:<field>``: the line ends before that field;
    - ``value:<field>``: that field is the first with a value it may not hold;
    - ``extra_fields``: all fields are right, and more follow;
    - the name of the cross-field check that failed.

    One carriage return at the end is not part of the line. An empty line is
    ``value`` of the first field. Rows, their repeats and all other columns
    stay as they are; columns of ``df`` named like ``reason`` or ``parsed``
    raise ``ValueError`` rather than being overwritten.
    """
    for name in (reason, parsed):
        if name.lower() in {c.lower() for c in df.columns}:
            raise ValueError(f"the input has a column {name!r} already; pass another name")
    text, raw = fresh("line_text", df), fresh("line_raw", df)
    n = len(schema.fields)
    whole = schema.line_pattern()
    df = df.withColumn(text, F.regexp_replace(col(line), r"\r\z", ""))
    # Each group is extracted by the one whole-line expression.
    matches = F.col(text).rlike(whole)
    df = df.withColumn(
        raw,
        F.when(matches, F.struct(*[_unquoted(F.regexp_extract(F.col(text), whole, i + 1)).alias(f.name) for i, f in enumerate(schema.fields)])),
    )
    fields = {f.name: F.col(f"{raw}.{f.name}") for f in schema.fields}
    broken = F.when(F.col(text).isNull(), "null_line")
    for check, holds in schema.checks:
        broken = broken.when(F.col(raw).isNotNull() & ~holds(fields), check)
    broken = broken.when(F.col(raw).isNotNull(), F.lit(None).cast("string"))
    for i, f in enumerate(schema.fields, 1):
        broken = broken.when(~F.col(text).rlike(schema.shape_pattern(i)), _missing_or(schema, text, i))
        broken = broken.when(~F.col(text).rlike(schema.prefix_pattern(i)), f"value:{f.name}")
    broken = broken.otherwise("extra_fields")
    return df.withColumn(reason, broken).withColumn(parsed, F.when(F.col(reason).isNull(), F.col(raw))).drop(text, raw)


def _missing_or(schema: LineSchema, text: str, i: int) -> Column:
    """Why the shape of field ``i`` fails though that of those before it holds."""
    name = schema.fields[i - 1].name
    if i == 1:
        return F.lit(f"quoting:{name}")
    ended = F.col(text).rlike(r"\A" + ",".join([schema.ANY] * (i - 1)) + r"\z")
    return F.when(ended, f"missing:{name}").otherwise(f"quoting:{name}")


def load_lines(df: DataFrame, line: str, schema: LineSchema = FASTQ_LINE) -> tuple[DataFrame, DataFrame]:
    """Split ``df`` into (valid rows with their record, other rows with a reason).

    Both frames keep every other column of ``df``; together they hold every row
    once. See :func:`parse_lines` for the added columns.
    """
    reason, record = fresh("reason", df), fresh("record", df)
    all_rows = parse_lines(df, line, schema, reason, record)
    return all_rows.filter(F.col(reason).isNull()).drop(reason), all_rows.filter(F.col(reason).isNotNull()).drop(record)
