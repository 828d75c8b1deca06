"""Fill-in-the-middle: texts cut into prefix, middle and suffix at unit boundaries and put in another order.

Each Arrow batch is registered, in slices, with a DuckDB connection of the task, and one SQL statement
makes the whole result: the units of a text, the cuts and the form (from a hash of a seed and the row's
key, so that reruns and other partitions agree), the output, and, from output and form alone, the text
again. No row is touched by Python, and nothing is shuffled.

Forms: plain (the text), psm (prefix, suffix, middle) and spm (suffix, prefix, middle), each part after
its mark. A text that is empty or contains a mark stays plain.

Results for odd input: a null text is empty; a null key is the empty string in the hash. Rows that repeat
a key and a text give equal results. A text of one unit has an empty prefix, middle or suffix. An empty
table gives an empty result. Extra columns are kept; columns named like a result are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sedgeline.llm.blocks import row_ranges

#: A line with its end, or a last line without one.
LINES = r"[^\n]*\n|[^\n]+"
#: Marks of prefix, suffix and middle.
MARKS = ("<P>", "<S>", "<M>")
FIELDS = (
    ("n", T.LongType()), ("form", T.StringType()), ("prefix_chars", T.LongType()), ("middle_chars", T.LongType()),
    ("output", T.StringType()), ("restored", T.StringType()), ("output_sha256", T.StringType()), ("restored_sha256", T.StringType()),
)


def _quoted(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def statement(units: str, seed: str, rate: int, spm: int, marks: tuple[str, str, str], texts: bool) -> str:
    """SQL over batch(row, key, body). rate: percent of texts that are cut, spm: percent of these in that form."""
    p, s, m = map(_quoted, marks)
    fields = [name for name, _ in FIELDS if texts or name not in ("output", "restored")]
    return rf"""
with drawn as (
  select row, coalesce(body, '') as body, regexp_extract_all(coalesce(body, ''), {_quoted(units)}) as units, sha256({_quoted(seed + ":")} || coalesce(key, '')) as draw from batch
), numbers as (
  select row, body, units, len(units) as n, list_transform([1, 9, 17, 25], lambda k: ('0x' || substr(draw, k, 8))::bigint) as h from drawn
), planned as (
  select *, least(h[1] % (n + 1), h[2] % (n + 1)) as low, greatest(h[1] % (n + 1), h[2] % (n + 1)) as high,
         case when body = '' or contains(body, {p}) or contains(body, {s}) or contains(body, {m}) or h[3] % 100 >= {int(rate)} then 'plain'
              when h[4] % 100 < {int(spm)} then 'spm' else 'psm' end as form
  from numbers
), parts as (
  select row, n, form, case when form = 'plain' then body end as body,
         case when form <> 'plain' then array_to_string(list_slice(units, 1, low), '') end as prefix,
         case when form <> 'plain' then array_to_string(list_slice(units, low + 1, high), '') end as middle,
         case when form <> 'plain' then array_to_string(list_slice(units, high + 1, n), '') end as suffix
  from planned
), made as (
  select row, n, form, length(prefix) as prefix_chars, length(middle) as middle_chars,
         case form when 'plain' then body when 'psm' then {p} || prefix || {s} || suffix || {m} || middle
                   else {s} || suffix || {p} || prefix || {m} || middle end as output
  from parts
), split as (
  select *, case when form <> 'plain' then strpos(output, case form when 'psm' then {s} else {p} end) end as second, case when form <> 'plain' then strpos(output, {m}) end as third from made
), again as (
  select row, n, form, prefix_chars, middle_chars, output,
         case form when 'plain' then output
                   when 'psm' then substr(output, {len(marks[0]) + 1}, second - {len(marks[0]) + 1}) || substr(output, third + {len(marks[2])}) || substr(output, second + {len(marks[1])}, third - second - {len(marks[1])})
                   else substr(output, second + {len(marks[0])}, third - second - {len(marks[0])}) || substr(output, third + {len(marks[2])}) || substr(output, {len(marks[1]) + 1}, second - {len(marks[1]) + 1}) end as restored
  from split
), hashed as (
  select *, sha256(output) as output_sha256, sha256(restored) as restored_sha256 from again
)
select {", ".join(fields)} from hashed order by row
"""


def fill_in_middle(
    docs: DataFrame, key: str = "doc_id", text: str = "text", units: str = LINES, seed: str = "7", rate: int = 100, spm: int = 50,
    marks: tuple[str, str, str] = MARKS, texts: bool = True,
) -> DataFrame:
    """docs with n (units), form, prefix_chars, middle_chars (null if plain), output, restored and the SHA-256 of both.

    units: a pattern whose matches, from left to right, make up the whole text. texts: False leaves
    output and restored out, so that only digests come back. marks: distinct; each begins with a
    character that it has nowhere else, so that no mark can begin inside a part and end in another mark.
    """
    if len(set(marks)) != 3 or any(not x or x[0] in other[1:] for x in marks for other in marks):
        raise ValueError("marks must be distinct, and their first characters nowhere else in them")
    if not 0 <= rate <= 100 or not 0 <= spm <= 100:
        raise ValueError("rate and spm are percents")
    fields = [T.StructField(name, kind) for name, kind in FIELDS if texts or name not in ("output", "restored")]
    names = [f.name for f in fields]
    kept = [c for c in docs.columns if c not in names]
    source = docs.select(F.col(key).cast("string").alias("__key"), F.col(text).alias("__text"), F.struct(*kept).alias("__kept"))
    query = statement(units, seed, rate, spm, marks, texts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import duckdb

        # One thread a task, as Spark deals out cores; nothing is written to the machine's disk.
        with duckdb.connect(":memory:", config={"threads": 1, "temp_directory": ""}) as con:
            for batch in batches:
                for first, end in row_ranges(batch.column("__text")):
                    part = batch.slice(first, end - first)
                    columns = [pa.array(range(len(part)), pa.int64()), part.column("__key"), part.column("__text")]
                    con.register("batch", pa.Table.from_arrays(columns, ["row", "key", "body"]))
                    made = con.sql(query).to_arrow_table().combine_chunks()
                    con.unregister("batch")
                    found = [made.column(name).combine_chunks().cast(pa.string() if isinstance(f.dataType, T.StringType) else pa.int64()) for name, f in zip(names, fields, strict=True)]
                    yield pa.RecordBatch.from_arrays([part.column("__kept"), *found], ["__kept", *names])

    schema = T.StructType([T.StructField("__kept", source.schema["__kept"].dataType), *fields])
    return source.mapInArrow(run, schema).select(*[F.col("__kept")[c].alias(c) for c in kept], *names)
