"""SQL in DuckDB's dialect for the queries of ``reads``."""

DNA = "translate(md5({}), '0123456789abcdef', 'ACGTACGTACGTACGT')"
RC = "reverse(translate({}, 'ACGTNacgtn', 'TGCANtgcan'))"

_MATES = f"""
WITH o AS (SELECT CAST(o_custkey % 50 AS INTEGER) AS file_id, o_orderkey AS rec_pos FROM orders),
a AS (SELECT file_id, rec_pos, '@r' || rec_pos || ' 1' AS header, {DNA.format("'a' || rec_pos")} AS seq FROM o),
b AS (SELECT file_id, rec_pos, '@r' || CASE WHEN rec_pos % 97 = 0 THEN rec_pos + 1 ELSE rec_pos END || ' 2' AS header2, {DNA.format("'b' || rec_pos")} AS seq2 FROM o),
linked AS (
  SELECT * FROM (SELECT file_id, header, seq, row_number() OVER (PARTITION BY file_id ORDER BY rec_pos) - 1 AS rec_no FROM a)
  JOIN (SELECT file_id, header2, seq2, row_number() OVER (PARTITION BY file_id ORDER BY rec_pos) - 1 AS rec_no FROM b) USING (file_id, rec_no))
"""

_LETTERS = "(VALUES ('A'), ('T'), ('G'), ('C'), ('N')) AS l(c)"
_VARIANTS = f"""
w AS (SELECT idx, barcode FROM {{list}} WHERE barcode IS NOT NULL),
p AS (SELECT idx, barcode, unnest(range(1, length(barcode) + 1)) AS i FROM w),
swapped AS (SELECT DISTINCT idx, barcode, left(barcode, i - 1) || c || substr(barcode, i + 1) AS variant FROM p, {_LETTERS} WHERE c <> substr(barcode, i, 1)),
added AS (SELECT DISTINCT idx, barcode, left(barcode, i - 1) || c || substr(barcode, i) AS variant
          FROM (SELECT idx, barcode, unnest(range(1, length(barcode) + 2)) AS i FROM w), {_LETTERS}),
dropped AS (SELECT DISTINCT idx, barcode, left(barcode, i - 1) || substr(barcode, i + 1) AS variant FROM p),
made AS (SELECT variant, min(barcode) AS barcode FROM (SELECT * FROM swapped UNION ALL SELECT * FROM added UNION ALL SELECT * FROM dropped) GROUP BY variant HAVING count(*) = 1),
corrections AS (SELECT variant, barcode FROM made WHERE variant NOT IN (SELECT barcode FROM w) UNION ALL SELECT DISTINCT barcode, barcode FROM w)
"""


def _with_variants(name: str, sql: str) -> str:
    return "WITH " + _VARIANTS.format(list=name) + sql


_MOVED = """, pairs AS (SELECT a.barcode, max_by(g.barcode, a.idx) AS translated FROM whitelist_atac a JOIN whitelist_gex g USING (idx) GROUP BY a.barcode)
"""

_SITES = """
WITH s AS (
  SELECT l_orderkey, l_linenumber, CAST((l_orderkey * 13 + l_partkey) % 1000 + 60 AS INTEGER) AS n, CAST(l_partkey % 700 AS INTEGER) AS pos,
         l_suppkey % 2 = 0 AS forward, (l_orderkey + l_partkey) % 3 AS kind,
         CAST((l_partkey * 7 + l_orderkey) % 900 AS INTEGER) AS a, CAST((l_suppkey * 31 + l_orderkey * 3) % 900 AS INTEGER) AS b
  FROM lineitem),
two AS (SELECT *, list_sort([a, a + 19, b, b + 18]) AS t FROM s),
bounds AS (
  SELECT *, CASE WHEN kind = 1 AND t[3] - t[2] >= 10 AND t[4] - t[1] >= 48 THEN t END AS strict,
         CASE WHEN kind = 0 AND forward AND pos < a + 19 THEN [0, a + 19, n, n] WHEN kind = 0 AND n - pos > a THEN [0, 0, a, n] END AS one
  FROM two)
"""

_EXACT = f"""
k AS (SELECT o_orderkey AS k, o_orderkey % 12 AS arm, o_orderkey % 24 < 12 AS forward, g.barcode AS g, a.barcode AS a, NOT starts_with(a.barcode, 'C') AS clear
      FROM orders JOIN whitelist_gex g ON g.idx = o_orderkey % 6000 JOIN whitelist_atac a ON a.idx = g.idx WHERE NOT contains(a.barcode, 'ATCTAC')),
b AS (SELECT *, CASE WHEN arm = 11 THEN 'other' WHEN arm IN (0, 1, 2, 7, 10) THEN 'gex' ELSE 'atac' END AS kind,
      CASE WHEN arm = 11 THEN NULL WHEN arm = 7 THEN left(g, 7) || translate(substr(g, 8, 1), 'ACGT', 'CATG') || substr(g, 9)
           WHEN arm = 10 THEN left({DNA.format("'x' || k")}, 16) WHEN arm = 8 AND clear THEN left(a, 9) || 'A' || substr(a, 10)
           WHEN arm = 9 AND clear THEN left(a, 9) || substr(a, 11) WHEN arm IN (0, 1, 2) THEN g ELSE a END AS bc,
      left({DNA.format("'u' || k")}, 12) AS umi, {" || ".join(DNA.format(f"'i{i}' || k") for i in range(4))} AS body FROM k),
-- Where the genomic part begins and ends before turning, and the read's length.
c AS (SELECT *, CASE kind WHEN 'gex' THEN 33 + 28 WHEN 'atac' THEN 29 + length(bc) + 22 + 19 END AS s,
      CASE kind WHEN 'gex' THEN 33 + 28 + 12 + 128 WHEN 'atac' THEN 29 + length(bc) + 22 + 19 + 128 END AS e,
      CASE kind WHEN 'gex' THEN 33 + 28 + 12 + 128 WHEN 'atac' THEN 29 + length(bc) + 22 + 19 + 128 + CASE WHEN arm = 6 THEN 0 ELSE 19 END ELSE 128 END AS n FROM b),
e AS (SELECT c.*, CASE kind WHEN 'gex' THEN (SELECT x.barcode FROM of_gex x WHERE x.variant = c.bc)
      WHEN 'atac' THEN (SELECT coalesce(p.translated, x.barcode) FROM of_atac x LEFT JOIN pairs p ON p.barcode = x.barcode WHERE x.variant = c.bc) END AS cb,
      CASE WHEN forward THEN s ELSE n - e END AS cut_start, CASE WHEN forward THEN e ELSE n - s END AS cut_end FROM c)
"""
_TWO_LISTS = "WITH " + ", ".join(
    f"of_{x} AS (WITH {_VARIANTS.format(list='whitelist_' + x)} SELECT variant, barcode FROM corrections)" for x in ("gex", "atac")
) + _MOVED + ", " + _EXACT
#: Without run-off kept, such reads are of no assay.
_STRICT = _TWO_LISTS + """, f AS (SELECT k, CASE WHEN arm = 6 THEN 'other' ELSE kind END AS route, bc, umi, cb, forward, cut_start, cut_end, n, body, arm FROM e)
"""

_PARTS = "CAST(floor(length(seq) / 4) AS INTEGER) AS a, CAST(floor(length(seq) / 2) AS INTEGER) AS b"


def _tag(name: str, value: str) -> str:
    return f"coalesce(' {name}=' || {value}, '')"


def _sam(prefix: str, tag: str) -> str:
    rest = f"substr(comment, strpos(comment, '{prefix}') + {len(prefix)})"
    value = f"CASE WHEN starts_with({rest}, ' ') THEN '' ELSE regexp_extract({rest}, '^\\s*(\\S*)', 1) END"
    return f"CASE WHEN contains(comment, '{prefix}') THEN '{tag}' || {value} || chr(9) ELSE '' END"


ORACLES = {
    "seq_reverse_complement": f"SELECT file_id, rec_pos, {RC.format('seq')} AS rc FROM reads",
    "seq_reverse": "SELECT file_id, rec_pos, reverse(qual) AS rev FROM reads",
    "qual_decode": """
SELECT file_id, rec_pos, array_to_string(q, ',') AS scores, CAST(coalesce(list_sum(q), CASE WHEN q IS NOT NULL THEN 0 END) AS BIGINT) AS total
FROM (SELECT file_id, rec_pos, CASE WHEN qual = '' THEN []::INTEGER[] ELSE list_transform(string_split(qual, ''), lambda c: ascii(c) - 33) END AS q FROM reads)""",
    "fastq_control_id": r"SELECT file_id, rec_pos, nullif(regexp_extract(header, '(\S+)', 1), '') AS control_id FROM reads",
    "fastq_linked": _MATES + "SELECT file_id, rec_no, header, header2, seq, seq2 FROM linked",
    "fastq_verify_ids": _MATES + "SELECT file_id, rec_no, starts_with(header2, split_part(header, ' ', 1)) AS same, split_part(header2, ' ', 1) = split_part(header, ' ', 1) AS same_strict FROM linked",
    "fastq_limit": _MATES + "SELECT file_id, rec_no, header FROM linked WHERE rec_no < 100",
    "fastq_format": f"""
SELECT row_id, '@r' || row_id || {" || ".join(_tag(k.upper(), k) for k in ("cb", "cr", "cy", "ub", "ur", "uy"))} || chr(10) || coalesce(cr, '') || chr(10) || '+' || chr(10) || coalesce(cy, '') AS record
FROM gex_tags""",
    "barcode_swap": _with_variants("whitelist_gex", "SELECT barcode, variant FROM swapped"),
    "barcode_insert": _with_variants("whitelist_gex", "SELECT barcode, variant FROM added"),
    "barcode_delete": _with_variants("whitelist_gex", "SELECT barcode, variant FROM dropped"),
    "correction_table": _with_variants("whitelist_gex", 'SELECT barcode, count(*) AS n, min(variant) AS "first", max(variant) AS "last" FROM corrections GROUP BY barcode'),
    "correct_barcode": _with_variants("whitelist_gex", "SELECT row_id, cr, c.barcode AS corrected FROM gex_tags LEFT JOIN corrections c ON c.variant = cr"),
    "correct_barcode_weighted": f"""
WITH w AS (SELECT barcode FROM whitelist_gex),
p AS (SELECT DISTINCT cr, cy FROM gex_tags WHERE length(cr) = 16 AND length(cy) = 16 AND cr NOT IN (SELECT barcode FROM w)),
n AS (SELECT cr, cy, barcode, {" + ".join(f"(substr(cr, {i}, 1) <> substr(barcode, {i}, 1))::INTEGER" for i in range(1, 17))} AS d,
      {" + ".join(f"CASE WHEN substr(cr, {i}, 1) <> substr(barcode, {i}, 1) THEN 1 + greatest((ascii(substr(cy, {i}, 1)) - 48) / 15.0::DOUBLE, 0) ELSE 0 END" for i in range(1, 17))} AS weight FROM p, w),
r AS (SELECT *, row_number() OVER (PARTITION BY cr, cy ORDER BY weight) AS place, lead(weight) OVER (PARTITION BY cr, cy ORDER BY weight) AS second FROM n),
c AS (SELECT cr, cy, barcode FROM r WHERE place = 1 AND d <= 2 AND weight < second - 0.5 UNION ALL SELECT DISTINCT cr, cy, cr FROM gex_tags WHERE cr IN (SELECT barcode FROM w))
SELECT row_id, t.cr, c.barcode AS corrected FROM gex_tags t LEFT JOIN c ON c.cr = t.cr AND c.cy IS NOT DISTINCT FROM t.cy""",
    "translate_barcode": "WITH x AS (SELECT 1)" + _MOVED + "SELECT row_id, cr, coalesce(translated, cr) AS translated FROM atac_tags LEFT JOIN pairs ON barcode = cr",
    "atac_tags": "WITH " + _VARIANTS.format(list="whitelist_atac") + _MOVED + f"""
SELECT row_id, '@' || {_tag('CB', 'cb')} || {_tag('CR', 'cr')} || {_tag('CY', 'cy')} AS tags, cb IS NOT NULL AS valid
FROM (SELECT row_id, cr, cy, coalesce(translated, c.barcode) AS cb
      FROM (SELECT row_id, cr, cy FROM atac_tags) LEFT JOIN corrections c ON c.variant = cr LEFT JOIN pairs ON pairs.barcode = c.barcode)""",
    "gex_tags": _with_variants("whitelist_gex", f"""
SELECT row_id, '@' || {_tag('CB', 'cb')} || {_tag('CR', 'cr')} || {_tag('CY', 'cy')} || {_tag('UB', 'ur')} || {_tag('UR', 'ur')} || {_tag('UY', 'uy')} AS tags, cb IS NOT NULL AS valid
FROM (SELECT row_id, cr, cy, ur, uy, c.barcode AS cb FROM gex_tags LEFT JOIN corrections c ON c.variant = cr)"""),
    "atac_intervals": _SITES + """
SELECT l_orderkey, l_linenumber, array_to_string(strict, ',') AS strict,
       array_to_string(coalesce(strict, CASE WHEN one[3] - one[2] >= 10 THEN one END), ',') AS runoff FROM bounds""",
    "gex_intervals": _SITES + """, g AS (
  SELECT l_orderkey, l_linenumber, CASE WHEN forward THEN least(pos + 28, n) ELSE 0 END AS x, CASE WHEN forward THEN n ELSE greatest(n - pos - 28, 0) END AS y FROM s)
SELECT l_orderkey, l_linenumber, CAST(CASE WHEN y - x >= 25 THEN x END AS INTEGER) AS cut_start, CAST(CASE WHEN y - x >= 25 THEN y END AS INTEGER) AS cut_end FROM g""",
    "technical_remainder": f"""
SELECT file_id, rec_pos, substr(seq, a + 1, b - a) AS genomic, substr(seq, 1, a) || '----' || substr(seq, b + 1) AS seq_rest,
       substr(qual, 1, a) || '----' || substr(qual, b + 1) AS qual_rest FROM (SELECT *, {_PARTS} FROM reads)""",
    "demux_exact": _TWO_LISTS + """
SELECT k AS rec_pos, kind AS route, CASE WHEN kind <> 'other' THEN CASE WHEN forward THEN '+' ELSE '-' END END AS strand, bc, cb, CASE WHEN kind = 'gex' THEN umi END AS umi,
       CAST(cut_start AS INTEGER) AS cut_start, CAST(cut_end AS INTEGER) AS cut_end, cb IS NOT NULL AS valid FROM e""",
    "demux_records": _STRICT + f""", r AS (
  SELECT *, '@o' || k AS id, CASE WHEN arm IN (0, 1, 2, 7) THEN '{{left}}' || bc || umi || repeat('T', 12) || body WHEN arm = 10 THEN '{{damaged}}' || bc || umi || repeat('T', 12) || body
            WHEN arm = 11 THEN body ELSE '{{atac}}' || bc || '{{right}}' || body || CASE WHEN arm = 6 THEN '' ELSE '{{back}}' END END AS built FROM f),
w AS (SELECT *, CASE WHEN forward THEN built ELSE {RC.format('built')} END AS seq FROM r),
h AS (SELECT *, coalesce(' CB=' || cb, '') || ' CR=' || bc || ' CY=' || repeat('I', length(bc)) AS tags FROM w),
o AS (SELECT k, route, id || CASE route WHEN 'gex' THEN tags || ' UB=' || umi || ' UR=' || umi || ' UY=' || repeat('I', 12) WHEN 'atac' THEN tags ELSE '' END AS header,
             CASE WHEN route = 'other' THEN seq ELSE substr(seq, cut_start + 1, cut_end - cut_start) END AS seq FROM h
      UNION ALL SELECT k, 'technical', id || tags, left(seq, cut_start) || '----' || substr(seq, cut_end + 1) FROM h WHERE route = 'atac')
SELECT k AS rec_pos, route, header, CAST(length(seq) AS INTEGER) AS n_seq, CAST(length(seq) AS INTEGER) AS n_qual, md5(seq) AS seq_md5 FROM o""".format(
        left="ACACTCTTTCCCTACACGACGCTCTTCCGATCT", damaged="ACACTCTTTCCCTACACGACTCTCTTACGATCT", atac="AATGATACGGCGACCACCGAGATCTACAC", right="CGCGTCTGTCGTCGGCAGCGTCAGATGTGTATAAGAGACAG", back="CTGTCTCTTATACACATCT"
    ),
    "anchor_hits": _TWO_LISTS + """
SELECT k AS rec_pos, bc || umi AS bc, CASE WHEN forward THEN '+' ELSE '-' END AS strand FROM e WHERE kind = 'gex'""",
    "exact_counts": _TWO_LISTS + """
SELECT CAST(k % 16 AS INTEGER) AS file_id, count(*) FILTER (kind = 'atac') AS atac, count(*) FILTER (kind = 'gex') AS gex, count(*) FILTER (kind = 'other') AS other FROM e GROUP BY k % 16""",
    "valid_only_filter": _STRICT + """
SELECT CAST(k % 16 AS INTEGER) AS file_id, count(*) FILTER (route = 'atac') AS atac, count(*) FILTER (route = 'gex') AS gex, count(*) FILTER (route = 'other') AS other
FROM f WHERE route = 'other' OR cb IS NOT NULL GROUP BY k % 16""",
    "bam_summary": """
SELECT barcode, coalesce(is_mapped, false) AS is_mapped, count(*) AS n,
       CAST(sum(((coalesce(length, 0) % 64) + 64) % 64) AS BIGINT) AS bases FROM bam_summary GROUP BY 1, 2""",
    "bam_split_rows": "SELECT aln_id, grp FROM bam_summary JOIN barcode_lookup USING (barcode) WHERE is_mapped",
    "bam_split_counts": """
SELECT g.grp, count(aln_id) AS n FROM (SELECT DISTINCT grp FROM barcode_lookup) g
LEFT JOIN (SELECT aln_id, grp FROM bam_summary JOIN barcode_lookup USING (barcode) WHERE is_mapped) s ON s.grp = g.grp GROUP BY g.grp""",
    "output_map_check": """
WITH a AS (SELECT DISTINCT grp FROM barcode_lookup), b AS (SELECT DISTINCT grp FROM (SELECT grp FROM barcode_lookup WHERE grp <> 'glia' UNION ALL SELECT r_name FROM region))
(SELECT grp FROM a EXCEPT SELECT grp FROM b) UNION ALL (SELECT grp FROM b EXCEPT SELECT grp FROM a)""",
    "sam_tags": f"""
WITH t AS (SELECT row_id, 'CB=' || coalesce(cb, '') || ' CR=' || coalesce(cr, '') || ' note UB=' || coalesce(ub, '') AS comment FROM gex_tags),
f AS (SELECT row_id, CASE WHEN row_id % 50 = 0 THEN '@CO' || chr(9) || comment WHEN row_id % 7 = 0 THEN 'r' || chr(9) || '4' || chr(9) || 'plain'
             ELSE 'r' || row_id || chr(9) || '4' || chr(9) || comment END AS raw FROM t),
s AS (SELECT row_id, regexp_replace(raw, '\\s+$', '') AS raw FROM f),
l AS (SELECT row_id, raw, regexp_extract(raw, '[^\\t]*$') AS comment FROM s)
SELECT row_id, CASE WHEN starts_with(raw, '@') THEN raw
  ELSE left(raw, length(raw) - length(comment)) || {_sam("CB=", "CB:Z:")} || {_sam("CR=", "CR:Z:")} || {_sam("UB=", "UB:Z:")} || comment END AS line FROM l""",
}
