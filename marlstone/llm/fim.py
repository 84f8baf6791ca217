"""Fill-in-middle: texts cut at boundaries of units into prefix, middle and suffix, and put together in another order.

A text is one numpy array of code points. Units (lines, words or characters) begin where the classes of two neighbouring
code points say so; ``flatnonzero`` of that comparison gives all boundaries, of which two are taken by their ranks. The
ranks and the order of the pieces come from a hash of the seed and the doc_id alone, so reruns and any dealing of the
rows agree.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SEED, RATE, SPM_RATE = 7, 100, 50
#: The code points of a line's end, and of blanks.
NEWLINE, BLANKS = 10, (9, 10, 11, 12, 13, 32)
UNITS = ("line", "word", "char")


def boundaries(cp: np.ndarray, unit: str = "line") -> np.ndarray:
    """Where units of the code points ``cp`` end, ascending; the last is the text's end. A text without any has none.

    A line ends after its line feed, a word before the next one (blanks before the first word are a unit of their own).
    """
    before, here = cp[:-1], cp[1:]
    if unit == "line":
        new = before == NEWLINE
    elif unit == "word":
        new = np.isin(before, BLANKS) & ~np.isin(here, BLANKS)
    elif unit == "char":
        new = np.ones(len(before), bool)
    else:
        raise ValueError(f"unit {unit!r} is none of {UNITS}")
    ends = np.flatnonzero(new) + 1
    return np.append(ends, len(cp)) if len(cp) else ends


def _text(cp: np.ndarray) -> str:
    return cp.tobytes().decode("utf-32-le")


def transform(docs: DataFrame, seed: int = SEED, rate: int = RATE, spm_rate: int = SPM_RATE, unit: str = "line") -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output), a row per row of ``docs`` (doc_id, text).

    n counts the units. Of 100 texts ``rate`` are cut, ``spm_rate`` of which have the suffix first (form spm, else psm);
    texts that are empty or hold one of the three marks stay as they are (plain, without lengths). Null texts are empty;
    a null doc_id is hashed as no digits; repeated rows each come back, alike. Whole texts are read, one of them is in
    memory at a time beside its batch. Other columns are not used; an empty table gives an empty result.
    """
    if unit not in UNITS:
        raise ValueError(f"unit {unit!r} is none of {UNITS}")
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"), 256)
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), *[F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long").alias(f"h{i + 1}") for i in range(4)])
    names = ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"]

    def cut(text: str, h1: int, h2: int, h3: int, h4: int) -> tuple:
        cp = np.frombuffer(text.encode("utf-32-le"), "<u4")
        ends = boundaries(cp, unit)
        n = len(ends)
        if not text or h3 % 100 >= rate or any(m in text for m in (PREFIX, SUFFIX, MIDDLE)):
            return n, "plain", None, None, text
        first, second = sorted((h1 % (n + 1), h2 % (n + 1)))
        a, b = (int(ends[r - 1]) if r else 0 for r in (first, second))
        prefix, middle, suffix = _text(cp[:a]), _text(cp[a:b]), _text(cp[b:])
        if h4 % 100 < spm_rate:
            return n, "spm", a, b - a, f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}"
        return n, "psm", a, b - a, f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string())
        for b in batches:
            hashes = [b.column(i).to_pylist() for i in range(2, 6)]
            out = [cut(t.as_py(), *h) for t, *h in zip(b.column(1), *hashes, strict=True)]
            columns = [pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([b.column(0), *columns], names)

    kind = docs.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, n long, form string, prefix_chars long, middle_chars long, output string")


def restored(output: Column, form: Column) -> Column:
    """The text that ``transform`` made ``output`` of, by nothing but it and its form; the marks part the pieces."""
    pieces = F.split(output, f"{PREFIX}|{SUFFIX}|{MIDDLE}", 4)
    back = lambda *order: F.concat(*[pieces[i] for i in order])
    return F.when(form == "psm", back(1, 3, 2)).when(form == "spm", back(2, 3, 1)).otherwise(output)


def op12_fim(spark, sf_dir: str) -> DataFrame:
    out = transform(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    return out.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", sha(F.col("output")).alias("output_sha256"),
        sha(restored(F.col("output"), F.col("form"))).alias("restored_sha256"),
    )


OP12_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS u, sha256('7:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
p AS (SELECT *, len(u) AS n, ('0x' || substr(h, 1, 8))::UBIGINT AS h1, ('0x' || substr(h, 9, 8))::UBIGINT AS h2, ('0x' || substr(h, 17, 8))::UBIGINT AS h3, ('0x' || substr(h, 25, 8))::UBIGINT AS h4 FROM d),
c AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1))::BIGINT AS a, greatest(h1 % (n + 1), h2 % (n + 1))::BIGINT AS b,
        CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 100 THEN 'plain' WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM p),
x AS (SELECT *, array_to_string(u[1:a], '') AS pre, array_to_string(u[a + 1:b], '') AS mid, array_to_string(u[b + 1:n], '') AS suf FROM c)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(pre) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(mid) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'spm' THEN '<S>' || suf || '<P>' || pre || '<M>' || mid ELSE '<P>' || pre || '<S>' || suf || '<M>' || mid END) AS output_sha256, sha256(t) AS restored_sha256
FROM x
"""
