"""From raw text to documents: main-text extraction, sections, Unicode inventory."""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodegauge.functions.text import strip

#: Characters of the inventory.
ODD = r"[^\n\t\x20-\x7e]"
#: Default markers of the main text and of section headings, as the format has them (fixed values). (?md): only \n ends
#: a line.
START, END = r"(?md)^CHAPTER\s+I\.", r"(?md)^THE END"
HEADING = r"(?md)^CHAPTER\s+(?:I|II|III|IV|V|VI|VII|VIII|IX|X|XI|XII)\.\s*.*$"


def extract_main_text(raw: DataFrame, column: str = "text", start: str = START, end: str = END) -> DataFrame:
    """The text from the first start marker up to the first end marker; a row without either fails the job."""
    a, b = F.regexp_instr(column, F.lit(start)), F.regexp_instr(column, F.lit(end))
    missing = F.raise_error(F.lit("start or end marker not found"))
    return raw.withColumn(column, F.when((a > 0) & (b > 0), F.substring(column, a, F.greatest(b - a, F.lit(0)))).otherwise(missing))


def split_sections(raw: DataFrame, prefix: str = "doc:ch", heading: str = HEADING, keep: tuple[str, ...] = ()) -> DataFrame:
    """(docid, title, text) by heading; docid is the ordinal of the heading. What stands before the first heading goes."""
    titles = F.regexp_extract_all("text", F.lit(f"({heading})"), F.lit(0))
    bodies = F.split("text", heading, -1)
    pairs = F.arrays_zip(titles.alias("title"), F.slice(bodies, 2, F.greatest(F.size(bodies) - 1, F.lit(0))).alias("body"))
    rows = raw.select(*keep, F.posexplode(pairs).alias("i", "s"))
    return rows.select(
        *keep, F.concat(F.lit(prefix), F.format_string("%02d", F.col("i") + 1)).alias("docid"), strip(F.col("s.title")).alias("title"), strip(F.col("s.body")).alias("text")
    )


def unicode_scan(docs: DataFrame, examples: int = 3, names: bool = True, normalize: bool = True) -> DataFrame:
    """Every character that is neither \\n, \\t nor printable ASCII: codepoint, ch, n, first examples (by docid and
    place) with their contexts (20 characters before, 19 after), how many more there are, and the character's name.

    Only rows with such characters reach Python, where a task counts its characters and keeps the first places of each;
    what is exchanged is a few rows a task and character, with the contexts of those places only.
    """
    odd = docs.select(F.col("docid").cast("string").alias("docid"), "text").where(F.col("text").rlike(ODD))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find, counts, firsts = re.compile(ODD).finditer, Counter(), {}
        for b in batches:
            for k, docid in enumerate(b.column(0).to_pylist()):
                text = b.column(1)[k].as_py()
                text = unicodedata.normalize("NFC", text) if normalize else text
                at: dict[str, list[int]] = {}
                for m in find(text):
                    at.setdefault(m[0], []).append(m.start())
                for ch, places in at.items():
                    counts[ch] += len(places)
                    few = firsts.setdefault(ch, [])
                    if len(few) == examples and few[-1][0] < (docid is not None, docid or ""):
                        continue
                    for i in places[:examples]:
                        context = text[max(i - 20, 0) : i + 20].replace("\n", "\\n").replace("\t", "\\t")
                        few.append(((docid is not None, docid or ""), i, docid, context))
                    firsts[ch] = sorted(few, key=lambda x: x[:2])[:examples]
        rows = [(ch, n, None, None, None) for ch, n in counts.items()] + [(ch, 0, x[2], x[1], x[3]) for ch, few in firsts.items() for x in few]
        types = (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string())
        columns = list(zip(*rows)) if rows else [()] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=["ch", "n", "docid", "i", "context"])

    found = odd.mapInArrow(scan, "ch string, n long, docid string, i long, context string")
    # a rank's limit is kept in every partition before the exchange
    order = Window.partitionBy("ch").orderBy("docid", "i")
    ranked = found.where("context is not null").withColumn("r", F.row_number().over(order)).where(F.col("r") <= examples)
    few = F.transform(F.array_sort(F.collect_list(F.struct("r", "context"))), lambda x: x["context"])
    out = found.groupBy("ch").agg(F.sum("n").alias("n")).join(ranked.groupBy("ch").agg(few.alias("examples")), "ch")
    out = out.select(F.expr("hex(encode(ch, 'utf-32'))").alias("hex"), "ch", "n", "examples", F.greatest(F.col("n") - examples, F.lit(0)).cast("long").alias("more"))
    out = out.withColumn("codepoint", F.conv("hex", 16, 10).cast("long")).drop("hex")
    if not names:
        return out.orderBy("codepoint")

    @F.pandas_udf("string")
    def name(chars):
        return chars.map(lambda c: unicodedata.name(c, "UNKNOWN"))

    return out.withColumn("name", name("ch")).orderBy("codepoint")


def unicode_report(rows: DataFrame) -> str:
    """The inventory as text: a line a character, its first contexts, and how many more there are."""
    out = []
    for r in rows.orderBy("codepoint").collect():  # one row a distinct character
        out.append(f"U+{r['codepoint']:04X} {r['ch']!r} {r['name']} ({r['n']})")
        out += [f"    ...{c}..." for c in r["examples"]] + ([f"    +{r['more']} more"] if r["more"] else [])
    return "\n".join(out)
