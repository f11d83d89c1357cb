"""Nested JSON scans: whole texts as VARIANT, fields by ordered alternative paths.

Three shapes share the machinery: lists of applicants, one profile a file, and a code-hosting
export of a profile with its repositories.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mergewell.functions import scalars as S
from mergewell.sources.records import SourceError, as_records, checked, source

# Paths in order of preference.
APPLICANT_PATHS = {
    "external_id": ("candidate_id", "id", "candidate.id"),
    "full_name": ("candidateName", "full_name", "name", "profile.full_name", "profile.name"),
    "emails": ("mail", "email", "emails", "contact.emails", "profile.emails"),
    "phones": ("phoneNumber", "phone", "phones", "contact.phones", "profile.phones"),
    "location": ("current_location", "location", "profile.location", "address.formatted"),
    "links": ("links", "profile.links", "social.links"),
    "headline": ("headline", "current_title", "summary", "profile.headline"),
    "years_experience": ("years_experience", "experience_years", "profile.years_experience"),
    "skills": ("skills", "profile.skills"),
    "experience": ("experience", "work_experience", "employment_history"),
    "education": ("education", "education_history"),
}
PROFILE_PATHS = {
    "full_name": ("name", "full_name", "fullName"),
    "headline": ("headline", "summary", "title"),
    "external_id": ("profile_url", "url", "linkedin_url", "public_profile_url"),
    "experience": ("experience", "positions", "work_experience"),
    "education": ("education", "schools", "education_history"),
    "skills": ("skills", "skill_names"),
}
TEXT_KEYS = ("value", "name", "label")
ITEM_KEYS = ("value", "email", "phone", "url", "name", "label", "skill")


def _path(v: Column, path: str) -> Column:
    """The value at a dotted path; null where it is missing or JSON null.  Lists on the way give lists."""
    out = v
    for part in path.split("."):
        step = f"$[{part}]" if part.isdigit() else f"$.{part}"
        direct = F.try_variant_get(out, step, "variant")
        if part.isdigit():
            out = direct
            continue
        fan = F.filter(F.transform(F.try_variant_get(out, "$", "array<variant>"), _getter(step)), lambda x: x.isNotNull())
        out = F.coalesce(direct, F.when(F.size(fan) > 0, F.to_variant_object(fan)))
    return F.when(~F.is_variant_null(out), out)


def _getter(step: str):
    return lambda x: F.try_variant_get(x, step, "variant")


def first_present(v: Column, paths: Sequence[str]) -> Column:
    """The first path that is there, be it empty."""
    return F.coalesce(*[_path(v, p) for p in paths])


def _array(v: Column) -> Column:
    return F.coalesce(F.try_variant_get(v, "$", "array<variant>"), F.when(v.isNotNull(), F.array(v)), F.array().cast("array<variant>"))


def _plain(x: Column) -> Column:
    """Text of a value that is no object; truth values are written with a capital."""
    text = F.try_variant_get(x, "$", "string")
    return F.nullif(F.when(F.schema_of_variant(x) == "BOOLEAN", F.initcap(text)).otherwise(text), F.lit(""))


def _scalar(x: Column, keys: Sequence[str]) -> Column:
    """Text of a value: of an object the first of ``keys``, else the value itself."""
    inner = F.coalesce(*[_plain(F.try_variant_get(x, f"$.{k}", "variant")) for k in keys])
    return F.when(F.schema_of_variant(x).startswith("OBJECT"), inner).otherwise(_plain(x))


def text_at(v: Column, paths: Sequence[str]) -> Column:
    items = F.filter(F.transform(_array(first_present(v, paths)), lambda x: _scalar(x, TEXT_KEYS)), lambda x: x.isNotNull())
    return F.get(items, 0)


def list_at(v: Column, paths: Sequence[str]) -> Column:
    return F.filter(F.transform(_array(first_present(v, paths)), lambda x: _scalar(x, ITEM_KEYS)), lambda x: x.isNotNull())


def objects_at(v: Column, paths: Sequence[str]) -> Column:
    """Objects as JSON texts; anything else as {"raw": ...}."""

    def entry(x: Column) -> Column:
        json = F.to_json(x)
        return F.when(F.schema_of_variant(x).startswith("OBJECT"), json).otherwise(F.concat(F.lit('{"raw":'), json, F.lit("}")))

    return F.transform(F.filter(_array(first_present(v, paths)), lambda x: ~F.is_variant_null(x)), entry)


def _number(text: Column) -> Column:
    return F.when(text.rlike(r"^\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$"), text.try_cast("double"))


def _raw_values(v: Column, paths: Mapping[str, Sequence[str]]) -> Column:
    rows = []
    for field, alternatives in paths.items():
        key = F.coalesce(*[F.when(_path(v, p).isNotNull(), F.lit(p)) for p in alternatives])
        rows.append(F.struct(F.lit(field).alias("field_name"), key.alias("source_key"), F.to_json(first_present(v, alternatives)).alias("value")))
    return F.filter(F.array(*rows), lambda x: x["value"].isNotNull())


def _files(spark: SparkSession, path: str, json_lines: bool = False) -> DataFrame:
    """(uri, v): a value a file, or with ``json_lines`` a value a line, which lets a large file be read by many tasks."""
    return spark.read.text(path, wholetext=not json_lines).select(F.try_parse_json("value").alias("v"), F.input_file_name().alias("uri"))


def _in_order(files: DataFrame, *position: str) -> DataFrame:
    """Add ``record_idx``: unique over all files, ascending by path, then by place in the file; with gaps."""
    return files.repartitionByRange("uri").sortWithinPartitions("uri", *position).withColumn("record_idx", F.monotonically_increasing_id())


def applicants(spark: SparkSession, path: str, paths: Mapping[str, Sequence[str]] | None = None, records_path: str = "candidates", source_name: str = "ats_json", ingested_at: str = "1970-01-01 00:00:00", json_lines: bool = False) -> DataFrame:
    """Records with ``error`` from a list of objects, an object that holds one, or a single object; files in order of their paths."""
    files = _files(spark, path, json_lines)
    if files.where("v is null").limit(1).count():
        raise SourceError(f"not JSON: {path}")
    inner = F.try_variant_get("v", f"$.{records_path}", "array<variant>")
    one = F.coalesce(F.try_variant_get("v", f"$.{records_path}", "variant"), F.col("v"))
    rows = F.coalesce(F.try_variant_get("v", "$", "array<variant>"), inner, F.array(one))
    rows = F.filter(rows, lambda x: F.schema_of_variant(x).startswith("OBJECT"))
    return from_variants(_in_order(files.select("uri", F.posexplode(rows).alias("_at", "v")), "_at"), paths, source_name, ingested_at)


def from_variants(df: DataFrame, paths: Mapping[str, Sequence[str]] | None = None, source_name: str = "ats_json", ingested_at: str = "1970-01-01 00:00:00", kind: str = "json") -> DataFrame:
    """The same from a frame of (record_idx, uri, v: variant)."""
    p, v = dict(paths or APPLICANT_PATHS), F.col("v")
    at = lambda f: p.get(f, ())
    text = lambda f: text_at(v, at(f)) if at(f) else F.lit(None).cast("string")
    many = lambda f: list_at(v, at(f)) if at(f) else F.array().cast("array<string>")
    objects = lambda f: objects_at(v, at(f)) if at(f) else F.array().cast("array<string>")
    years = text("years_experience")
    df = df.withColumn("error", F.when(years.isNotNull() & _number(years).isNull(), "years_experience is not a number"))
    out = as_records(
        df,
        record_idx=F.col("record_idx"),
        source=source(kind, source_name, text("external_id"), F.col("uri"), ingested_at),
        external_id=text("external_id"), full_name=text("full_name"), location=text("location"), headline=text("headline"),
        years_experience=_number(years), emails=many("emails"), phones=many("phones"), links=many("links"), skills=many("skills"),
        experience=objects("experience"), education=objects("education"), projects=objects("projects"),
        raw_values=_raw_values(v, p), raw_payload=F.to_json(v),
    )
    return checked(out)


def _unwrapped(keys: Sequence[str]) -> Column:
    """The first of the keys that holds a non-empty object, else the whole."""
    full = [F.when(F.size(F.json_object_keys(F.to_json(F.try_variant_get("v", f"$.{k}", "variant")))) > 0, F.try_variant_get("v", f"$.{k}", "variant")) for k in keys]
    return F.coalesce(*full, F.col("v"))


def profiles(spark: SparkSession, path: str, source_name: str = "linkedin_profile", ingested_at: str = "1970-01-01 00:00:00") -> DataFrame:
    """One record a file; an object without any signal is an error."""
    files = _in_order(_files(spark, path).select("uri", _unwrapped(("linkedin_profile", "profile")).alias("v")))
    return linked_profiles(files, source_name, ingested_at)


def linked_profiles(df: DataFrame, source_name: str = "linkedin_profile", ingested_at: str = "1970-01-01 00:00:00") -> DataFrame:
    """The same from a frame of (record_idx, uri, v: variant)."""
    out = from_variants(df, PROFILE_PATHS, source_name, ingested_at, "linkedin")
    out = out.withColumn("links", F.when(F.col("external_id").isNotNull(), F.array("external_id")).otherwise(F.col("links")))
    empty = F.col("full_name").isNull() & F.col("headline").isNull() & F.col("external_id").isNull() & (F.size("experience") + F.size("education") + F.size("skills") == 0)
    return out.withColumn("error", F.coalesce("error", F.when(empty, "no profile field")))


def repositories(spark: SparkSession, path: str, source_name: str = "github_profile", ingested_at: str = "1970-01-01 00:00:00") -> DataFrame:
    """One record a file of a profile and its repositories; languages are skills, repositories experience."""
    files = _files(spark, path)
    v = _unwrapped(("profile", "user"))
    repos = F.coalesce(F.try_variant_get("v", "$.repositories", "array<variant>"), F.try_variant_get("v", "$.repos", "array<variant>"), F.array().cast("array<variant>"))
    return exported_profiles(_in_order(files.select("uri", v.alias("v"), repos.alias("repos"))), source_name, ingested_at)


def _field(name: str) -> Column:
    return F.nullif(F.try_variant_get("v", f"$.{name}", "string"), F.lit(""))


def _raw(name: str, key: str, value: Column) -> Column:
    return F.struct(F.lit(name).alias("field_name"), F.lit(key).alias("source_key"), value.alias("value"))


def _list_json(items: Column) -> Column:
    return F.concat(F.lit("["), F.array_join(F.transform(items, lambda r: F.to_json(r)), ","), F.lit("]"))


def exported_profiles(df: DataFrame, source_name: str = "github_profile", ingested_at: str = "1970-01-01 00:00:00") -> DataFrame:
    """Records with ``error`` from (record_idx, uri, v, repos) of exports; a profile without anything is an error."""
    login = F.coalesce(_field("login"), _field("username"))
    url = F.coalesce(_field("html_url"), F.concat(F.lit("https://github.com/"), login))
    languages = F.concat(F.coalesce(F.try_variant_get("v", "$.languages", "array<string>"), F.array().cast("array<string>")), F.transform("repos", lambda r: F.try_variant_get(r, "$.language", "string")))
    skills = S.dedup_ci(F.filter(languages, lambda x: x.isNotNull() & (x != "")))
    repos = F.transform("repos", lambda r: F.to_json(r))
    named = [("username", login), ("name", _field("name")), ("bio", _field("bio")), ("location", _field("location"))]
    values = F.filter(F.array(*[_raw(n, n, c) for n, c in named], _raw("languages", "languages", F.when(F.size(skills) > 0, F.to_json(skills))), _raw("repositories", "repositories", F.when(F.size("repos") > 0, _list_json(F.col("repos"))))), lambda x: x["value"].isNotNull())
    empty = F.coalesce(login, url, _field("name"), _field("bio"), _field("location")).isNull() & (F.size(skills) + F.size("repos") == 0)
    df = df.withColumn("error", F.when(empty, "no profile field"))
    return checked(as_records(df, record_idx=F.col("record_idx"), source=source("github", source_name, login, F.col("uri"), ingested_at), external_id=login, full_name=_field("name"), headline=_field("bio"), location=_field("location"), links=F.filter(F.array(url), lambda x: x.isNotNull()), skills=skills, experience=repos, raw_values=values, raw_payload=F.to_json("v")))


#: What is kept of a fetched repository (fixed values).
REPOSITORY_KEYS = ("name", "full_name", "html_url", "description", "language", "stargazers_count", "forks_count", "updated_at")


def fetched_profiles(df: DataFrame, source_name: str = "github_api", ingested_at: str = "1970-01-01 00:00:00") -> DataFrame:
    """Records with ``error`` from (record_idx, url, v, repos) as a profile service returns them."""
    login, url, blog = _field("login"), F.coalesce(_field("html_url"), F.col("url")), S.link(_field("blog"))["url"]
    skills = S.dedup_ci(F.filter(F.transform("repos", lambda r: F.try_variant_get(r, "$.language", "string")), lambda x: x.isNotNull() & (x != "")))
    kept = F.transform("repos", lambda r: F.to_json(F.struct(*[F.try_variant_get(r, f"$.{k}", "string" if k not in ("stargazers_count", "forks_count") else "bigint").alias(k) for k in REPOSITORY_KEYS]), {"ignoreNullFields": "false"}))
    named = [("username", "login", login), ("github_url", "html_url", url), ("bio", "bio", _field("bio")), ("company", "company", _field("company")), ("location", "location", _field("location")), ("emails", "email", _field("email")), ("blog", "blog", _field("blog"))]
    named += [(k, k, _field(k)) for k in ("public_repos", "followers", "following")]
    values = F.filter(F.array(*[_raw(*x) for x in named], _raw("languages", "repositories.language", F.when(F.size(skills) > 0, F.to_json(skills))), _raw("repositories", "repositories", _list_json(F.col("repos")))), lambda x: x["value"].isNotNull())
    some = lambda *cs: F.filter(F.array(*cs), lambda x: x.isNotNull())
    payload = F.concat(F.lit('{"profile":'), F.to_json("v"), F.lit(',"repositories":'), _list_json(F.col("repos")), F.lit("}"))
    return checked(as_records(df, record_idx=F.col("record_idx"), source=source("github", source_name, login, F.col("url"), ingested_at), external_id=login, full_name=_field("name"), emails=some(_field("email")), headline=_field("bio"), location=_field("location"), links=some(url, blog), skills=skills, experience=kept, raw_values=values, raw_payload=payload))


def username(url: Column) -> tuple[Column, Column]:
    """(user name, problem) of a profile link; one of them is null."""
    v = S.strip_ws(url)
    host = F.regexp_replace(F.lower(F.regexp_extract(v, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)), r"^www\.", "")
    name = F.nullif(F.regexp_extract(v, r"^[^:]*://[^/?#]*/+([^/?#]+)", 1), F.lit(""))
    problem = (
        F.when(~F.lower(v).rlike("^https?:"), "link must start with http:// or https://")
        .when(host != "github.com", "link must use github.com")
        .when(name.isNull(), "link must have a user name")
        .when(F.lower(name).isin("orgs", "organizations", "settings", "marketplace", "features"), "link must lead to a user profile")
    )
    return F.when(problem.isNull() & v.isNotNull(), name), F.when(v.isNull(), "no link").otherwise(problem)


def code_profiles(urls: DataFrame, profiles_table: DataFrame, source_name: str = "github_api", ingested_at: str = "1970-01-01 00:00:00") -> tuple[DataFrame, DataFrame]:
    """Lookup source: (record_idx, url) joined to (login, v, repos); unmatched and malformed links become warnings."""
    name, problem = username(F.col("url"))
    known = urls.withColumn("_name", F.lower(name)).withColumn("_problem", problem)
    joined = known.join(profiles_table.withColumn("login", F.lower("login")), known["_name"] == F.col("login"), "left")
    warnings = joined.where("v is null").select("record_idx", "url", F.coalesce("_problem", F.lit("profile not found")).alias("warning"))
    return fetched_profiles(joined.where("v is not null"), source_name, ingested_at), warnings


def fetch_profiles(urls: DataFrame, fetch, source_name: str = "github_api", ingested_at: str = "1970-01-01 00:00:00") -> tuple[DataFrame, DataFrame]:
    """The same by a client: ``fetch(login)`` gives (profile, repositories) or raises; it runs once a distinct login.

    Fetched payloads are kept as JSON texts; what a login's call raises becomes the warning of its links.
    """
    import json

    name, _ = username(F.col("url"))
    logins = urls.select(name.alias("login")).where("login is not null").groupBy(F.lower("login").alias("key")).agg(F.min("login").alias("login"))

    def call(batches):
        for frame in batches:
            rows = []
            for login in frame["login"]:
                try:
                    profile, repositories = fetch(login)
                    rows.append((json.dumps(profile), json.dumps(repositories), None))
                except Exception as e:  # one profile's failure is a warning, not the job's
                    rows.append((None, None, str(e)))
            yield frame[["key"]].assign(profile=[r[0] for r in rows], repositories=[r[1] for r in rows], problem=[r[2] for r in rows])

    got = logins.mapInPandas(call, "key string, profile string, repositories string, problem string")
    repos = F.coalesce(F.try_variant_get(F.try_parse_json("repositories"), "$", "array<variant>"), F.array().cast("array<variant>"))
    table = got.select(F.col("key").alias("login"), F.try_parse_json("profile").alias("v"), repos.alias("repos"), "problem")
    name, malformed = username(F.col("url"))
    joined = urls.withColumn("_name", F.lower(name)).withColumn("_problem", malformed).join(table, F.col("_name") == F.col("login"), "left")
    warnings = joined.where("v is null").select("record_idx", "url", F.coalesce("_problem", "problem", F.lit("profile not found")).alias("warning"))
    return fetched_profiles(joined.where("v is not null"), source_name, ingested_at), warnings


def rest_client(base: str, headers: Mapping[str, str] | None = None, timeout: int = 10, page_size: int = 100):
    """A ``fetch`` for :func:`fetch_profiles` over HTTP: the profile, then its repositories page by page."""
    given = dict(headers or {})

    def get(url: str):
        import json
        import urllib.error
        import urllib.request

        try:
            with urllib.request.urlopen(urllib.request.Request(url, headers={"Accept": "application/json", **given}), timeout=timeout) as r:
                return json.loads(r.read().decode())
        except urllib.error.HTTPError as e:
            kind = {404: "profile not found", 403: "rate limit or access denied", 401: "not authorized"}.get(e.code, f"HTTP status {e.code}")
            raise SourceError(kind) from e
        except urllib.error.URLError as e:
            raise SourceError(f"service not reached: {e.reason}") from e

    def fetch(login: str):
        profile, repositories, page = get(f"{base}/users/{login}"), [], 1
        while True:
            some = get(f"{base}/users/{login}/repos?per_page={page_size}&page={page}")
            repositories += some
            if len(some) < page_size:
                return profile, repositories
            page += 1

    return fetch


def profile_links(text: str) -> list[str]:
    """The distinct code-host profile links of a text, one a line, in order; other lines are passed over."""
    from urllib.parse import urlsplit

    out: dict[str, str] = {}
    for line in text.splitlines():
        url = line.strip()
        if not url or any(c.isspace() for c in url):
            continue
        url = url if "://" in url else f"https://{url}"
        if urlsplit(url).scheme.lower() in ("http", "https") and "github.com" in urlsplit(url).netloc.lower():
            out.setdefault(url.rstrip("/").casefold(), url)
    return list(out.values())
