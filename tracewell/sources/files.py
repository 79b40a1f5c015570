"""Files: office documents, raw trees, batch lists, links."""

from __future__ import annotations

import hashlib
import io
import os
import re
import zipfile
from xml.etree import ElementTree

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.functions.text import url_unpath
from tracewell.sources.paths import Folder

CHUNK = 1 << 20
#: Kinds of files that hold text we can read, and known ones that we cannot.
READABLE = (".docx", ".xlsx")
UNREADABLE = (".pages", ".numbers", ".key", ".doc", ".xls", ".pdf")
WORD = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
SHEET = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"


def docx_text(data: bytes) -> str:
    """Paragraphs of a text document, runs of empty lines reduced to one; empty without its main part."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        if "word/document.xml" not in z.namelist():
            return ""
        root = ElementTree.fromstring(z.read("word/document.xml"))
    lines = ["".join(t.text or "" for t in p.iter(f"{WORD}t")).strip() for p in root.iter(f"{WORD}p")]
    return re.sub(r"\n{3,}", "\n\n", "\n".join(lines)).strip()


def xlsx_text(data: bytes) -> str:
    """Sheets of a workbook by name of their part, cells parted by tabs, blank rows left out."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        names = set(z.namelist())
        shared: list[str] = []
        if "xl/sharedStrings.xml" in names:
            items = ElementTree.fromstring(z.read("xl/sharedStrings.xml")).iter(f"{SHEET}si")
            shared = ["".join(t.text or "" for t in si.iter(f"{SHEET}t")) for si in items]
        out = []
        for name in sorted(n for n in names if re.fullmatch(r"xl/worksheets/sheet[^/]*\.xml", n)):
            out.append(f"# {name.rsplit('/', 1)[-1].removesuffix('.xml')}")
            for row in ElementTree.fromstring(z.read(name)).iter(f"{SHEET}row"):
                cells = [_cell(c, shared) for c in row.iter(f"{SHEET}c")]
                if any(x.strip() for x in cells):
                    out.append("\t".join(cells))
    return "\n".join(out)


def _cell(cell, shared: list[str]) -> str:
    value = cell.find(f"{SHEET}v")
    if cell.get("t") == "inlineStr":
        return "".join(t.text or "" for t in cell.iter(f"{SHEET}t"))
    text = (value.text or "") if value is not None else ""
    if cell.get("t") == "s":
        return shared[int(text)] if text.isdigit() and int(text) < len(shared) else ""
    return text


def embedded_media(data: bytes) -> list[tuple[str, bytes]]:
    """(name, bytes) of the pictures inside a document, by name."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        return [(n.rsplit("/", 1)[-1], z.read(n)) for n in sorted(z.namelist()) if re.fullmatch(r"(word|xl)/media/[^/]+", n)]


def extract(files: DataFrame) -> DataFrame:
    """(path, text, chars, images, problem) of files (path, content); broken and unreadable ones have a problem."""

    def run(batches):
        import pandas as pd

        for batch in batches:
            rows = []
            for path, content in zip(batch.path, batch.content):
                suffix = os.path.splitext(str(path))[1].lower()
                text, images, problem = None, 0, None
                if suffix not in READABLE:
                    problem = "known but unreadable" if suffix in UNREADABLE else "unknown kind"
                else:
                    try:
                        text = (docx_text if suffix == ".docx" else xlsx_text)(bytes(content))
                        images = len(embedded_media(bytes(content)))
                    except (zipfile.BadZipFile, ElementTree.ParseError, TypeError, KeyError):
                        problem = "broken"
                rows.append((path, text, len(text) if text is not None else None, images, problem))
            yield pd.DataFrame(rows, columns=["path", "text", "chars", "images", "problem"]).astype({"chars": "Int64"})

    return files.select("path", "content").mapInPandas(run, "path string, text string, chars bigint, images bigint, problem string")


def fingerprints(files: DataFrame) -> DataFrame:
    """(path, sha256) of files (path, content)."""
    return files.select("path", F.sha2("content", 256).alias("sha256"))


def raw_tree(spark: SparkSession, root: str) -> DataFrame:
    """(path, size, sha256) of every file below a folder of any shared file system, hidden ones too.

    Only the entries directly below are listed on the driver; folders are listed, and contents read, in the tasks.
    """
    folder = Folder(spark, root)
    base = root if "://" in root else f"file://{os.path.abspath(root)}"

    def listed(batches):
        import pandas as pd
        import pyarrow.fs as pafs

        fs, top = pafs.FileSystem.from_uri(base)
        for batch in batches:
            for name in batch.path:
                info = fs.get_file_info(f"{top}/{name}")
                found = [info] if info.is_file else fs.get_file_info(pafs.FileSelector(info.path, recursive=True))
                rows = [(f.path.removeprefix(top).lstrip("/"), f.size) for f in found if f.is_file]
                yield pd.DataFrame(rows, columns=["path", "size"]).astype({"size": "int64"})

    def hashed(batches):
        import pyarrow.fs as pafs

        fs, top = pafs.FileSystem.from_uri(base)
        for batch in batches:
            sums = []
            for path in batch.path:
                digest = hashlib.sha256()
                with fs.open_input_stream(f"{top}/{path}") as f:
                    while chunk := f.read(CHUNK):
                        digest.update(chunk)
                sums.append(digest.hexdigest())
            yield batch.assign(sha256=sums)

    names = spark.createDataFrame([(n,) for n in folder.names()], "path string").mapInPandas(listed, "path string, size bigint")
    return names.repartition("path").mapInPandas(hashed, "path string, size bigint, sha256 string")


def batch_lines(lines: DataFrame) -> DataFrame:
    """(line_no, text, refs) of a list (line_no, value): one record per line, ``:: ref, ref`` after it.

    Blank lines and those that begin with ``#`` are left out, list marks before the text too. A line without a text
    before ``::`` has a null text: that is an error of the list.
    """
    clean = F.trim(F.regexp_replace(F.trim("value"), r"^[-* ]+", ""))
    rows = lines.select("line_no", clean.alias("_v")).where("_v <> '' and not _v like '#%'")
    parts = F.split("_v", "::", 2)
    refs = F.filter(F.transform(F.split(F.coalesce(F.try_element_at(parts, F.lit(2)), F.lit("")), ","), lambda x: F.trim(x)), lambda x: x != "")
    return rows.select("line_no", F.nullif(F.trim(parts[0]), F.lit("")).alias("text"), refs.alias("refs"))


def terms(lines: DataFrame) -> DataFrame:
    """Distinct terms of a list (value): one per line, blanks and what follows ``#`` left out."""
    return lines.select(F.trim(F.regexp_replace("value", "#.*$", "")).alias("term")).where("term <> ''").distinct()


def leaked_terms(documents: DataFrame, listed: DataFrame) -> DataFrame:
    """(doc, term): terms of one word that documents (doc, text) contain, without regard to case."""
    words = documents.select("doc", F.explode(F.array_distinct(F.split(F.lower("text"), r"[^\p{L}\p{N}_-]+"))).alias("word"))
    return words.join(listed.select(F.lower("term").alias("word"), "term"), "word").select("doc", "term").distinct()


LINK = r"\[[^\]]*\]\(([^)\s]+)\)"


def markdown_links(documents: DataFrame) -> DataFrame:
    """(doc, target) of relative links in documents (doc, text), decoded, without fragment; each once."""
    found = documents.select("doc", F.explode(F.regexp_extract_all("text", F.lit(LINK), F.lit(1))).alias("target"))
    bare = F.regexp_replace("target", "#.*$", "")
    rows = found.select("doc", bare.alias("target")).where((F.col("target") != "") & ~F.regexp_like("target", F.lit(r"^(https?:|mailto:)")))
    return rows.select("doc", url_unpath(F.col("target")).alias("target")).distinct()


def web_links(documents: DataFrame) -> DataFrame:
    """(doc, url) of web addresses in documents (doc, text); each once."""
    return documents.select("doc", F.explode(F.regexp_extract_all("text", F.lit(r"https?://[A-Za-z0-9./_-]*[A-Za-z0-9/_-]"), F.lit(0))).alias("url")).distinct()
