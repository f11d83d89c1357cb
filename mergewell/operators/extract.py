"""Fields out of résumé text, by native expressions over its lines."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mergewell.functions import scalars as S
from mergewell.schema import OBJECT_LISTS
from mergewell.sources.records import as_records, checked, source

# What results must equal.
EMAIL = r"(?i)[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}"
PHONE = r"(?:\+\d{1,3}[\s().-]*)?(?:\d[\s().-]*){7,}\d"
URL = r"(?i)(?:https?://|www\.)[^\s,;)]+"
YEAR = r"\b(?:19|20)\d{2}\b"
_MONTH = r"(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[a-z]*\s+\d{4}"
DURATION = rf"(?i)({_MONTH}|\d{{4}})\s*-\s*(Present|Current|Now|{_MONTH}|\d{{4}})"
SKILLS = ("Python", "Java", "JavaScript", "TypeScript", "Node.js", "React", "Django", "FastAPI", "Flask", "AWS", "GCP", "Azure", "Docker", "Kubernetes", "SQL", "PostgreSQL", "MongoDB", "Redis", "Spark", "Kafka")
SECTIONS = {
    "experience": ("experience", "work experience", "professional experience", "employment"),
    "education": ("education", "academic"),
    "projects": ("projects", "project"),
    "certifications": ("certifications", "certification", "licenses"),
    "skills": ("skills", "technical skills", "technologies"),
    "summary": ("summary", "profile", "objective"),
}


def lines_of(text: Column) -> Column:
    """Stripped lines that are not blank."""
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), r"\R"), S.strip_ws), lambda x: x != "")


def _header(line: Column) -> Column:
    key = F.regexp_replace(S.fold(line), r"[:\s]+$", "")
    out = F.lit(None).cast("string")
    for name, aliases in SECTIONS.items():
        out = F.when(key.isin(*aliases), name).otherwise(out)
    return out


def heads(lines: Column) -> Column:
    """The header lines in order: struct(at, name, upto), the last being where the next one stands."""
    found = F.filter(F.transform(lines, lambda x, i: F.struct(i.alias("at"), _header(x).alias("name"))), lambda h: h["name"].isNotNull())
    upto = lambda h, k: F.coalesce(F.get(h, k + 1)["at"], F.size(lines))
    return S.let(found, lambda h: F.transform(h, lambda x, k: F.struct(x["at"].alias("at"), x["name"].alias("name"), upto(h, k).alias("upto"))))


def section(lines: Column, name: str, of: Column | None = None) -> Column:
    """A section's lines; what stands before the first header belongs to none.  ``of`` are the lines' :func:`heads`, if at hand."""
    mine = F.filter(heads(lines) if of is None else of, lambda h: h["name"] == name)
    return F.flatten(F.transform(mine, lambda h: F.slice(lines, h["at"] + 2, h["upto"] - h["at"] - 1)))


def emails(text: Column) -> Column:
    return S.dedup_ci(F.filter(F.transform(F.regexp_extract_all(text, F.lit(EMAIL), F.lit(0)), S.email), lambda x: x.isNotNull()))


def phones(text: Column) -> Column:
    return F.array_distinct(F.filter(F.transform(F.regexp_extract_all(text, F.lit(PHONE), F.lit(0)), lambda x: S.phone(x)), lambda x: x.isNotNull()))


def links(text: Column) -> Column:
    found = F.transform(F.regexp_extract_all(text, F.lit(URL), F.lit(0)), lambda x: S.link(F.regexp_replace(x, r"\.+$", ""))["url"])
    return S.dedup_ci(F.filter(found, lambda x: x.isNotNull()))


def known_skills(text: Column) -> Column:
    """Dictionary terms that stand in the text, in the dictionary's order."""
    import re

    quoted = [F.struct(F.lit(s).alias("s"), F.lit(rf"(?i)(?<![A-Za-z0-9]){re.escape(s)}(?![A-Za-z0-9])").alias("p")) for s in SKILLS]
    return F.transform(F.filter(F.array(*quoted), lambda x: F.regexp(text, x["p"])), lambda x: x["s"])


def _object(**fields: Column) -> Column:
    return F.to_json(F.struct(*[v.alias(k) for k, v in fields.items()]))


def experience(lines: Column) -> Column:
    """Entries of lines of four characters or more: raw, duration, start, end, and title and company where " at " parts them."""

    def one(x: Column) -> Column:
        empty = lambda c: F.nullif(c, F.lit(""))
        until = F.regexp_extract(x, DURATION, 2)
        parts = F.split(x, r"(?i)\s+at\s+", 2)
        two = F.lower(x).contains(" at ")
        title = F.regexp_replace(F.get(parts, 0), "^[ -]+|[ -]+$", "")
        company = S.strip_ws(F.get(F.split(F.get(parts, 1), " - ", 2), 0))
        return _object(
            raw=x, duration=empty(F.regexp_extract(x, DURATION, 0)), start=S.date(empty(F.regexp_extract(x, DURATION, 1))),
            end=F.when(~F.lower(until).isin("present", "current", "now"), S.date(empty(until))), title=F.when(two, title), company=F.when(two, company),
        )

    return F.transform(F.slice(F.filter(lines, lambda x: F.length(x) >= 4), 1, 10), one)


#: Fixed value.
DEGREE = r"(?i)\b(?:B\.?S\.?|M\.?S\.?|BTech|MTech|Bachelor|Master|MBA|PhD)\b[^,;-]*"


def education(lines: Column) -> Column:
    """Entries of lines of three characters or more: raw, graduation_year, degree, institution."""
    empty = lambda c: F.nullif(S.strip_ws(c), F.lit(""))
    one = lambda x: _object(raw=x, graduation_year=empty(F.regexp_extract(x, f"({YEAR})", 1)), degree=empty(F.regexp_extract(x, DEGREE, 0)), institution=empty(F.get(F.split(x, r",| - ", 2), 0)))
    return F.transform(F.slice(F.filter(lines, lambda x: F.length(x) >= 3), 1, 5), one)


def projects(lines: Column) -> Column:
    """Names and descriptions of lines of three characters or more."""
    named = F.transform(F.filter(lines, lambda x: F.length(x) >= 3), lambda x: F.struct(F.regexp_replace(F.get(F.split(x, r":| - ", 2), 0), "^[-* ]+|[-* ]+$", "").alias("name"), x.alias("x")))
    return F.transform(F.slice(F.filter(named, lambda e: e["name"] != ""), 1, 10), lambda e: _object(name=e["name"], description=e["x"]))


def certifications(lines: Column) -> Column:
    return S.dedup_ci(F.filter(F.transform(lines, lambda x: F.regexp_replace(x, r"^[-* ]+|[-* ]+$", "")), lambda x: x != ""))


def resumes(df: DataFrame, source_name: str = "resume", ingested_at: str = "1970-01-01 00:00:00") -> DataFrame:
    """Records with ``error`` from (record_idx, path, text); how text left its document is up to the reader.

    A null or blank text is an error, and so is what a column ``error`` says already.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    df = df.withColumn("_l", lines_of(F.col("text"))).withColumn("_heads", heads(F.col("_l")))
    for name in SECTIONS:
        df = df.withColumn(f"_{name}", section(F.col("_l"), name, F.col("_heads")))
    unread = F.when(F.size("_l") == 0, F.concat(F.lit("no text in "), F.coalesce(F.col("path"), F.lit("(no path)"))))
    df = df.withColumn("error", F.coalesce(F.col("error"), unread) if "error" in df.columns else unread)
    file = S.base_name(F.col("path"))
    external = F.coalesce(F.get("_f_emails", 0), F.regexp_replace(file, r"(?<=.)\.[^.]*$", ""))
    summary = F.nullif(F.substring(F.array_join("_summary", " "), 1, 500), F.lit(""))
    name = F.get(F.filter(F.slice("_l", 1, 6), lambda x: ~(x.contains("@") | F.lower(x).contains("http") | x.rlike(r"\p{Nd}")) & (F.size(F.split(x, r"\s+")) <= 5)), 0)
    place = F.get(F.filter(F.transform(F.filter(F.slice("_l", 1, 8), lambda x: x.contains(",") & ~(x.contains("@") | F.lower(x).contains("http"))), lambda x: S.location(x)["raw"]), lambda x: x.isNotNull()), 0)
    in_section = F.when(F.size("_skills") > 0, F.array_join("_skills", "\n")).otherwise(text)
    columns = {
        "emails": emails(text), "phones": phones(text), "location": place, "links": links(text), "skills": S.skills(known_skills(in_section)),
        "experience": experience(F.col("_experience")), "education": education(F.col("_education")), "projects": projects(F.col("_projects")),
        "certifications": certifications(F.col("_certifications")), "resume_summary": summary,
    }
    # each field is worked out once; records and raw values both name it
    df = df.withColumns({f"_f_{k}": c for k, c in columns.items()})
    columns = {k: F.col(f"_f_{k}") for k in columns}
    as_json = lambda k, c: S.json_text(c) if k in ("location", "resume_summary") else F.when(F.size(c) > 0, F.concat(F.lit("["), F.array_join(c, ","), F.lit("]")) if k in OBJECT_LISTS else F.to_json(c))
    raw = [F.struct(F.lit(k).alias("field_name"), F.lit(k).alias("source_key"), as_json(k, c).alias("value")) for k, c in columns.items()]
    values = F.filter(F.array(*raw), lambda x: x["value"].isNotNull())
    payload = F.to_json(F.struct(file.alias("filename"), F.col("text")))
    return checked(as_records(df, record_idx=F.col("record_idx"), source=source("resume", source_name, file, F.col("path"), ingested_at), external_id=external, full_name=name, headline=columns["resume_summary"], resume_file=file, raw_values=values, raw_payload=payload, **columns))


def document_text(files: DataFrame, pdf: Callable[[bytes], str] | None = None) -> DataFrame:
    """(path, text, error) of (path, content): DOCX by Python's own means, PDF by the reader given.

    DOCX gives paragraphs that are not blank, then table cells.  A file that cannot be read, another suffix, and a PDF
    without a reader give a null text and the reason; none ends the job.
    """
    import io
    import zipfile
    from xml.etree import ElementTree

    w = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"

    def docx(content: bytes) -> str:
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{w}body")
        words = lambda e: "".join(t.text or "" for t in e.iter(f"{w}t"))
        return "\n".join(x for x in [words(p) for p in body.findall(f"{w}p")] + [words(c) for c in body.iter(f"{w}tc")] if x.strip())

    def one(path: str, content: bytes) -> tuple[str | None, str | None]:
        suffix = path.rsplit(".", 1)[-1].casefold() if "." in path.replace("\\", "/").rsplit("/", 1)[-1] else ""
        reader = {"docx": docx, "pdf": pdf}.get(suffix)
        if reader is None:
            return None, f"no reader for PDF: {path}" if suffix == "pdf" else f"unsupported document: {path}"
        try:
            return reader(content), None
        except Exception as e:  # whatever a broken file makes its reader do is that file's failure
            return None, f"cannot read {path}: {e}"

    def read(batches):
        for frame in batches:
            got = [one(p, c) for p, c in zip(frame["path"], frame["content"], strict=True)]
            yield frame[["path"]].assign(text=[g[0] for g in got], error=[g[1] for g in got])

    return files.select("path", "content").mapInPandas(read, "path string, text string, error string")


def docx_text(files: DataFrame) -> DataFrame:
    """(path, text) of (path, content) DOCX files; null for what cannot be read."""
    return document_text(files).select("path", "text")
