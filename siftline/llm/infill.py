"""Fill-in-the-middle: texts cut into units, and put together again with the middle last.

Every Arrow batch of a task is registered with a DuckDB connection of the
task's own; SQL cuts, hashes and joins, and Arrow comes back.  No row passes
through Python by itself.  A document's cuts and form follow from its id alone, so
a task that runs again gives the same rows.

A batch goes to DuckDB in slices of about ``arrow.SLICE_BYTES`` of text, so memory
follows the longest text, not the batch.
"""

from __future__ import annotations

from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftline.llm.arrow import map_arrow, text_slices


@dataclass(frozen=True)
class Infill:
    """How texts are cut and marked.

    ``unit`` is a pattern that cuts a text into units without gaps; ``rate`` of
    a hundred documents are transformed, ``spm`` of a hundred of those in the
    order suffix, prefix, middle.
    """

    seed: int = 7
    rate: int = 100
    spm: int = 50
    unit: str = r"[^\n]*\n|[^\n]+"
    prefix: str = "<P>"
    suffix: str = "<S>"
    middle: str = "<M>"

    def __post_init__(self):
        marks = (self.prefix, self.suffix, self.middle)
        if len(set(marks)) < 3 or not all(marks):
            raise ValueError("three marks that differ and aren't empty are needed")
        for x in marks:
            for y in marks:  # else a mark could begin within another, and a text not be restored
                if any(x[-k:] == y[:k] for k in range(1, min(len(x), len(y)))) or (x != y and x in y):
                    raise ValueError("no mark may overlap another or itself")


def literal(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def transform_sql(how: Infill) -> str:
    """(id, n, form, prefix_chars, middle_chars, output) of ``batch`` (id, text)."""
    p, s, m = map(literal, (how.prefix, how.suffix, how.middle))
    number = lambda k: f"CAST('0x' || substr(h, {8 * k - 7}, 8) AS UBIGINT)"
    return f"""
hashed AS (SELECT id, coalesce(text, '') AS t, sha256('{how.seed}:' || coalesce(CAST(id AS VARCHAR), '')) AS h FROM batch),
cut AS (SELECT id, t, regexp_extract_all(t, {literal(how.unit)}) AS u, {number(1)} AS h1, {number(2)} AS h2, {number(3)} AS h3, {number(4)} AS h4 FROM hashed),
placed AS (SELECT *, CAST(len(u) AS BIGINT) AS n, CAST(least(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS BIGINT) AS a, CAST(greatest(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS BIGINT) AS b,
  CASE WHEN t = '' OR contains(t, {p}) OR contains(t, {s}) OR contains(t, {m}) OR h3 % 100 >= {how.rate} THEN 'plain' WHEN h4 % 100 < {how.spm} THEN 'spm' ELSE 'psm' END AS form FROM cut),
parts AS (SELECT id, t, n, form, CASE WHEN form <> 'plain' THEN array_to_string(list_slice(u, 1, a), '') END AS prefix,
  CASE WHEN form <> 'plain' THEN array_to_string(list_slice(u, a + 1, b), '') END AS middle, CASE WHEN form <> 'plain' THEN array_to_string(list_slice(u, b + 1, n), '') END AS suffix FROM placed),
transformed AS (SELECT id, n, form, CAST(length(prefix) AS BIGINT) AS prefix_chars, CAST(length(middle) AS BIGINT) AS middle_chars,
  CASE form WHEN 'plain' THEN t WHEN 'psm' THEN {p} || prefix || {s} || suffix || {m} || middle ELSE {s} || suffix || {p} || prefix || {m} || middle END AS output FROM parts)"""


def restore_sql(how: Infill, source: str) -> str:
    """(all of ``source``, restored): the text from its output and form."""
    p, s, m = map(literal, (how.prefix, how.suffix, how.middle))

    def between(x: str, y: str) -> str:
        """What lies between the first mark x, which is in front, and the first y behind it, which ends the part."""
        return f"substr(output, length({x}) + 1, strpos(output, {y}) - length({x}) - 1)"

    def after(x: str, y: str) -> str:
        return f"substr(output, strpos(output, {x}) + length({x}), strpos(output, {y}) - strpos(output, {x}) - length({x}))"

    tail = f"substr(output, strpos(output, {m}) + length({m}))"
    psm = f"{between(p, s)} || {tail} || {after(s, m)}"
    spm = f"{after(p, m)} || {tail} || {between(s, p)}"
    return f"SELECT *, CASE form WHEN 'psm' THEN {psm} WHEN 'spm' THEN {spm} ELSE output END AS restored FROM {source}"


def in_duckdb(rows: DataFrame, text_col: str, sql: str, schema: str) -> DataFrame:
    """``sql`` over each slice of the rows as table ``batch``; what it returns has ``schema``."""
    from pyspark.sql.types import _parse_datatype_string
    from pyspark.sql.pandas.types import to_arrow_schema

    target = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches):
        import duckdb

        with duckdb.connect(config={"threads": 1, "temp_directory": ""}) as db:
            for part, _, _ in text_slices(batches, text_col):
                if not part.num_rows:
                    continue
                db.register("batch", pa.Table.from_batches([part]))
                found = db.sql(sql).to_arrow_table()
                db.unregister("batch")
                yield from found.cast(target).to_batches()

    return map_arrow(rows, run, schema)


def _rows(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))


def fill_in_middle(df: DataFrame, how: Infill = Infill(), *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n, form, prefix_chars, middle_chars, output) for every row of ``df``.

    ``n`` units; ``form`` is plain, psm or spm; lengths are in code points and
    null for plain rows, whose output is the text.  A null text is the empty
    one, which is plain with no unit.  A null id hashes as the empty string; rows
    that repeat an id are cut alike where they have as many units.  Other
    columns of ``df``, whatever their names, aren't read.  No rows: no rows.
    """
    sql = f"WITH {transform_sql(how)} SELECT * FROM transformed"
    return in_duckdb(_rows(df, id_col, text_col), "text", sql, "id long, n long, form string, prefix_chars long, middle_chars long, output string")


def restored(df: DataFrame, how: Infill = Infill(), *, id_col: str = "id", output_col: str = "output", form_col: str = "form") -> DataFrame:
    """(id, text): the texts that ``fill_in_middle`` was given, from output and form alone."""
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(output_col).alias("output"), F.col(form_col).alias("form"))
    return in_duckdb(rows, "output", f"SELECT id, restored AS text FROM ({restore_sql(how, 'batch')})", "id long, text string")


def infill_digests(df: DataFrame, how: Infill = Infill(), *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256) for every row, in one pass.

    The digests are of the UTF-8 bytes of what ``fill_in_middle`` and
    ``restored`` give; texts stay in the task.
    """
    sql = f"WITH {transform_sql(how)}, back AS ({restore_sql(how, 'transformed')}) SELECT id AS doc_id, n, form, prefix_chars, middle_chars, sha256(output) AS output_sha256, sha256(restored) AS restored_sha256 FROM back"
    return in_duckdb(_rows(df, id_col, text_col), "text", sql, "doc_id long, n long, form string, prefix_chars long, middle_chars long, output_sha256 string, restored_sha256 string")
