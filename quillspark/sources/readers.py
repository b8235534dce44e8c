"""Readers: uploads by format (text, EPUB, PDF), JSON lines, essay collections and page cleaning."""

from __future__ import annotations

import io
import posixpath
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.functions import text as T

SUFFIXES = (".txt", ".pdf", ".epub")


class UnsupportedFormatError(ValueError):
    """A file of none of the supported formats."""


class ExtractionError(ValueError):
    """A file without readable text."""


def epub_sections(content: bytes) -> list[tuple[int, str]]:
    """(place in reading order, markup) of an EPUB: container -> package -> spine -> items."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        container = ElementTree.fromstring(z.read("META-INF/container.xml"))
        package = next(e.attrib["full-path"] for e in container.iter() if e.tag.endswith("rootfile"))
        tree, base = ElementTree.fromstring(z.read(package)), posixpath.dirname(package)
        hrefs = {e.attrib["id"]: e.attrib["href"] for e in tree.iter() if e.tag.endswith("}item")}
        order = [e.attrib["idref"] for e in tree.iter() if e.tag.endswith("}itemref")]
        names, out = set(z.namelist()), []
        for ref in order:
            name = posixpath.normpath(posixpath.join(base, hrefs.get(ref, "")))
            if ref in hrefs and name in names:
                out.append((len(out) + 1, z.read(name).decode("utf-8", "ignore")))
        return out


def pdf_pages(content: bytes) -> list[tuple[int, str]]:
    """(page, text); needs the optional pypdf."""
    try:
        from pypdf import PdfReader
    except ImportError as e:
        raise ExtractionError("PDF support needs pypdf") from e
    return [(k, p.extract_text() or "") for k, p in enumerate(PdfReader(io.BytesIO(content)).pages, 1)]


def read_uploads(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """(path, section, text, error): one row a section of each file under path. What can't be read is a row with an error, so
    that one bad file doesn't end the job; ``strict`` raises for those."""

    def parts(name: str, content: bytes) -> list[tuple[int, str, str, str | None]]:
        suffix = posixpath.splitext(name.lower())[1]
        try:
            if suffix == ".txt":
                return [(1, content.decode("utf-8", "ignore"), "text", None)]
            if suffix == ".epub":
                return [(k, t, "markup", None) for k, t in epub_sections(content)]
            if suffix == ".pdf":
                return [(k, t, "text", None) for k, t in pdf_pages(content)]
            return [(0, "", "text", f"unsupported format '{suffix or 'unknown'}'")]
        except Exception as e:  # whatever a broken file raises is that file's error
            return [(0, "", "text", f"{type(e).__name__}: {e}"[:200])]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(p, *x) for p, c in zip(pdf["path"], pdf["content"]) for x in parts(p, bytes(c))]
            yield pd.DataFrame(rows, columns=["path", "section", "raw", "kind", "error"])

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(path).select("path", "content")
    rows = files.mapInPandas(run, "path string, section int, raw string, kind string, error string")
    text = F.when(F.col("kind") == "markup", T.markup_to_text("raw")).otherwise(T.normalize_text("raw"))
    rows = rows.select("path", "section", text.alias("text"), "error")
    empty = F.col("error").isNull() & (F.col("text") == "")
    return rows.withColumn("error", F.when(empty, "no readable text").otherwise(F.col("error")))


def strict(uploads: DataFrame) -> DataFrame:
    """Raises for the first file that couldn't be read."""
    bad = uploads.where("error is not null and error <> 'no readable text'").orderBy("path").first()
    if bad is not None:
        raise (UnsupportedFormatError if bad["error"].startswith("unsupported") else ExtractionError)(f"{bad['path']}: {bad['error']}")
    return uploads.where("error is null")


def read_jsonl(spark: SparkSession, path: str, schema: str, keep_bad: bool = False) -> DataFrame:
    """JSON lines by a given schema; bad lines are left out, or kept in ``_bad``."""
    if keep_bad:
        return spark.read.schema(f"{schema}, _bad string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_bad").json(path)
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("errorifexists").json(path)


def held_out_essays(essays: DataFrame, excluded: DataFrame, fewest: int = 400) -> DataFrame:
    """essays (title, text) without excluded titles and those of under ``fewest`` non-blank characters."""
    n = T.non_blank_length("text").cast("long")
    return essays.join(excluded.select("title").distinct(), "title", "left_anti").withColumn("char_count", n).where(F.col("char_count") >= fewest)


def page_links(html: Column) -> Column:
    """The targets of a page's links, in order."""
    return F.regexp_extract_all(html, F.lit(r'<a\s+[^>]*href="([^"#]+)'), F.lit(1))


def clean_body(text: Column, markers: list[str], fewest: int = 2) -> Column:
    """Lines up to the first that begins with a boilerplate marker, without those shorter than ``fewest`` characters."""
    lines = F.transform(F.split(text, "\n"), lambda x: T.strip(x))
    marked = F.transform(lines, lambda x: T.any_of([F.startswith(x, F.lit(m)) for m in markers]))
    cut = F.array_position(marked, True)
    kept = F.when(cut > 0, F.slice(lines, F.lit(1), F.greatest(cut.cast("int") - 1, F.lit(0)))).otherwise(lines)
    return F.array_join(F.filter(kept, lambda x: F.length(x) >= fewest), "\n")


def resolve_inputs(spark: SparkSession, paths: list[str], recursive: bool = True) -> DataFrame:
    """(path, length) of the inputs: files as they are named, folders as their .txt and .json files (any case), sorted by path; contents are not read."""
    path = spark._jvm.org.apache.hadoop.fs.Path
    out = None
    for one in paths:
        files = path(one).getFileSystem(spark._jsc.hadoopConfiguration())
        found = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(one).select("path", "length")
        if files.getFileStatus(path(one)).isDirectory():
            found = found.where(F.lower("path").rlike(r"\.(txt|json)$"))
        out = found if out is None else out.unionByName(found)
    return (out if out is not None else spark.createDataFrame([], "path string, length long")).orderBy("path")


PROBE = "id string, persona string, prompt string, target_dims array<string>, note string"


def read_probes(spark: SparkSession, path: str, schema: str = PROBE) -> DataFrame:
    """Style probes, one JSON line each; a persona that a line lacks is its file's name."""
    rows = read_jsonl(spark, path, schema).select("*", F.regexp_extract("_metadata.file_name", r"^(.*)\.jsonl$", 1).alias("file"))
    return rows.withColumn("persona", F.coalesce("persona", "file")).drop("file")


CONDITIONS = ("neutral", "style_only", "thinking_only", "full", "wrong_persona")


def system_prompts(packs: DataFrame, neutral: str, hint: str) -> DataFrame:
    """packs (persona, body, thinking_body, style_prompt, other: whose body the wrong persona has) -> (persona, condition, prompt), five conditions a persona."""
    other = packs.select(F.col("persona").alias("other"), F.col("body").alias("other_body"))
    rows = packs.join(other, "other", "left")
    texts = {"full": F.concat("body", F.lit("\n\n")), "thinking_only": F.concat("thinking_body", F.lit("\n\n")), "style_only": F.col("style_prompt"), "neutral": F.lit(neutral), "wrong_persona": F.concat("other_body", F.lit("\n\n"))}
    prompts = F.array(*[F.struct(F.lit(c).alias("condition"), F.concat(texts[c], F.lit(hint)).alias("prompt")) for c in CONDITIONS])
    return rows.select("persona", F.inline(prompts))
