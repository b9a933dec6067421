"""Findings, raw reports and lookup tables derived row by row from the given tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from credsift.functions.keys import finding_id
from credsift.schema import FINDING_COLUMNS, TOOLS
from credsift.session import spread
from credsift.sources.variants import once


PARTS_A_TASK = 50_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _text(column: Column) -> Column:
    return column.cast("string")


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The keys of all line items."""
    keys = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    items = table(spark, sf_dir, "lineitem").select(*keys)
    return spread(items, *keys).toDF(*_KEYS)


_KEYS = ["ok", "ln", "pk", "sk"]


def _repository(repos: int = 8) -> Column:
    return F.concat(F.lit("repo-"), _text(F.col("sk") % repos)).alias("repository")


def _marks(secrets: int = 400) -> list[Column]:
    return [
        (F.col("pk") % secrets).alias("kk"),
        (F.col("ok") % 4).alias("tt"),
        (F.col("ok") % 20).alias("shape"),
    ]


def _base() -> Column:
    # hex digits of both ways, in capitals without a look at the language's rules for them
    return F.concat(F.lit("AKIA"), F.hex(F.unhex(F.left(F.md5(_text(F.col("kk"))), F.lit(16)))))


def _marked(spark: SparkSession, sf_dir: str, secrets: int = 400, repos: int = 8) -> DataFrame:
    """Line items with a secret number, repository, tool number and base value."""
    rows = _items(spark, sf_dir).select(*_KEYS, _repository(repos), *_marks(secrets))
    return once(rows, base=_base())


def lineitem_findings(
    spark: SparkSession, sf_dir: str, secrets: int = 400, repos: int = 8
) -> DataFrame:
    """Findings of four tools: repeats, other files, missing locations, nested contexts."""
    kk, tt, base = F.col("kk"), F.col("tt"), F.col("base")
    nowhere = (tt == 3) & (F.col("ok") % 3 == 0)
    name = F.concat(F.lit("f"), _text(kk % 40), F.lit(".py"))
    by_tool = lambda *options: F.element_at(F.array(*options), (tt + 1).cast("int"))
    value = by_tool(
        base,
        F.concat(F.left(base, F.lit(8)), F.lit("\n"), F.substr(base, F.lit(9))),
        F.concat(F.lit('"aws_key" = "'), base, F.lit('";')),
        F.concat(F.lit("AWS_KEY="), base),
    )
    marked = once(_marked(spark, sf_dir, secrets, repos), secret_value=value)
    rows = marked.select(
        "repository",
        F.when(nowhere, "")
        .when(F.col("ln") >= 6, F.concat(F.lit("test/"), name))
        .otherwise(F.concat(F.lit("src/"), name))
        .alias("file_path"),
        F.when(~nowhere, (kk % 30 + 1).cast("int")).alias("line_number"),
        by_tool(
            *map(F.lit, ("aws-access-token", "AWS", "Secret Keyword", "AWS API Credentials"))
        ).alias("secret_type"),
        "secret_value",
        F.when(nowhere, "").otherwise(F.md5(_text(kk % 50))).alias("commit_hash"),
        F.array(by_tool(*map(F.lit, TOOLS[:4]))).alias("found_by"),
        F.struct("ok", "ln", "pk", "sk").alias("seq"),
    )
    return rows.withColumn(
        "id", finding_id(F.col("repository"), F.col("file_path"), F.col("secret_value"))
    ).select(*FINDING_COLUMNS, "seq")


def _run_path(tool: str) -> Column:
    run = F.concat_ws("-", *(F.lpad(_text(F.col(c)), 12, "0") for c in ("ok", "ln", "pk", "sk")))
    return F.concat(F.lit("/drop/"), run, F.lit("/"), F.col("repository"), F.lit("/" + tool))


def _landing(rows: DataFrame, tool: str, value: Column) -> DataFrame:
    zero = F.lit(0).cast("bigint")
    return once(rows, path=_run_path(tool), value=value).select(
        "repository",
        F.lit(tool).alias("tool"),
        "path",
        zero.alias("block"),
        zero.alias("pos"),
        "value",
    )


def _js(*parts: str | Column) -> Column:
    return F.concat(*(F.lit(p) if isinstance(p, str) else _text(p) for p in parts))


def _gitleaks_report() -> Column:
    """One report per line item: two records, or one of several broken shapes."""
    kk, base, shape = F.col("kk"), F.col("base"), F.col("shape")
    full = _js(
        '{"Description": "AWS Access Key", "StartLine": ', kk % 30 + 1,
        ', "File": "src/f', kk % 40, '.py", "Commit": "', F.md5(_text(kk % 50)),
        '", "Secret": "', base, '", "RuleID": "aws-access-token"}',
    )
    second = (
        F.when(F.col("ln") == 1, _js('{"File": "test/f', kk % 40, '.py", "Secret": ""}'))
        .when(F.col("ln") == 7, _js("7"))
        .otherwise(
            _js('{"File": null, "StartLine": 0, "RuleID": null, "Secret": "',
                F.left(base, F.lit(8)), "\\n  ", F.substr(base, F.lit(9)), '"}')
        )
    )
    return (
        F.when(shape == 0, "{corrupt")
        .when(shape == 1, full)
        .when(shape == 2, "[]")
        .otherwise(_js("[\n", full, ",\n", second, "\n]"))
    )


def gitleaks_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _landing(_marked(spark, sf_dir), "gitleaks", _gitleaks_report())


def trufflehog_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One line per line item, well formed or one of several broken shapes."""
    kk, base, shape = F.col("kk"), F.col("base"), F.col("shape")
    git = _js(
        '{"Data": {"Git": {"file": "src/f', kk % 40, '.py", "commit": "',
        F.md5(_text(kk % 50)), '", "line": ', kk % 30 + 1, "}}}",
    )

    def line(secret: str | Column, meta: str | Column = git, name: str = '"AWS"') -> Column:
        return _js('{"SourceMetadata": ', meta, ", ", secret, ', "DetectorName": ', name, "}")

    raw = _js('"Raw": "', F.left(base, F.lit(8)), "\\n", F.substr(base, F.lit(9)), '"')
    redacted = _js('"Redacted": "', F.left(base, F.lit(6)), '***"')
    value = (
        F.when(shape == 0, '{"bad json')
        .when(shape == 1, _js("[", line(raw), "]"))
        .when(shape == 2, "   ")
        .when(shape == 3, line(_js('"Raw": "", ', redacted)))
        .when(shape == 4, line(_js('"Raw": null, ', redacted)))
        .when(shape == 5, line(redacted))
        .when(shape == 6, line(raw, '{"Data": {"Git": null}}'))
        .when(shape == 7, _js("{", raw, "}"))
        .when(shape == 8, line('"Raw": 12'))
        .when(shape == 9, line(raw, '{"Data": {"Git": {"file": "a.py"}}}', "null"))
        .otherwise(line(raw))
    )
    return _landing(_marked(spark, sf_dir), "trufflehog", value)


def detect_secrets_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One report per line item with hits in two files, or one of several other shapes."""
    kk, shape = F.col("kk"), F.col("shape")
    digest = F.md5(_text(kk))
    value = (
        F.when(shape == 0, '{"results": {}}')
        .when(shape == 1, "[]")
        .when(shape == 2, '{"bad json')
        .when(shape == 3, '{"version": "1.0"}')
        .otherwise(
            _js(
                '{"results": {"src/f', kk % 40, '.py": [{"type": "Secret Keyword", ',
                '"hashed_secret": "', digest, '", "line_number": ', kk % 30 + 1, "}], ",
                '"test/f', kk % 40, '.py": [{"hashed_secret": "', digest,
                '", "line_number": 3}, {"type": "Broken", "line_number": 9}]}}',
            )
        )
    )
    return _landing(_marked(spark, sf_dir), "detect-secrets", value)


def source_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Source lines behind two thirds of the detect-secrets hits in ``src``."""
    kk = F.col("kk")
    return (
        _marked(spark, sf_dir)
        .filter(kk % 3 != 0)
        .groupBy(
            "repository",
            F.concat(F.lit("src/f"), _text(kk % 40), F.lit(".py")).alias("file_path"),
            (kk % 30 + 1).cast("int").alias("line_number"),
        )
        .agg(F.min(F.concat(F.lit('\t "aws_key" = "'), "base", F.lit('";  '))).alias("line"))
    )


def _b64(text: Column) -> Column:
    return F.base64(F.encode(text, "utf-8"))


def _titus_report() -> Column:
    """One report per line item: a finding with matches and one without, or broken shapes."""
    kk, base, shape = F.col("kk"), F.col("base"), F.col("shape")
    blob = F.md5(_text(kk))
    start = _js('"Location": {"Source": {"Start": {"Line": ', kk % 30 + 1, "}}}")
    with_name = _js(
        '{"BlobID": "', blob, '", "RuleName": "AWS Key", "Snippet": {"Matching": "',
        _b64(F.concat(F.lit("AWS_KEY="), base)), '"}, ', start, "}",
    )
    unnamed = _js(
        '{"BlobID": "', blob, '", "RuleName": "", "Snippet": {"Matching": "',
        _b64(F.concat(F.lit("  "), base, F.lit("\n"))), '"}, "Location": {}}',
    )
    blank = _js('{"BlobID": "', blob, '", "Snippet": {"Matching": "', _b64(F.lit(" ")), '"}}')
    broken = '{"Snippet": null}'
    matched = _js(
        '{"RuleID": "np.aws.6", "RuleName": "AWS API Credentials", "Groups": ["',
        _b64(base), '"], "Matches": [', with_name, ", ", unnamed, ", ", blank, ", ", broken,
        "]}",
    )
    grouped = _js(
        "{", F.when(shape < 10, '"RuleID": "np.aws.1", ').otherwise(""),
        '"RuleName": null, "Groups": ["', _b64(base), '"], "Matches": ',
        F.when(shape % 2 == 0, "null").otherwise("[]"), "}",
    )
    return (
        F.when(shape == 0, "{bad")
        .when(shape == 1, matched)
        .when(shape == 2, "[]")
        .when(shape == 3, _js("[", matched, ', {"Groups": []}, 5]'))
        .otherwise(_js("[", matched, ", ", grouped, "]"))
    )


def titus_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _landing(_marked(spark, sf_dir), "titus", _titus_report())


# Tasks that the reports of repositories are dealt to, so that few of them get two.
REPORT_TASKS = 256


def repository_report_lines(spark: SparkSession, sf_dir: str, tool: str) -> DataFrame:
    """Lines of one long report per repository: the records of all usable reports of a tool, in
    their order, behind a record that nobody can use.

    A report is written by one task, which sorts keys alone and makes the texts while it writes.
    """
    report = {"gitleaks": _gitleaks_report, "titus": _titus_report}[tool]()
    # usable reports are arrays with records: not the first three shapes, nor one without a value
    usable = F.col("kk").isNotNull() & ~F.coalesce(F.col("shape").isin(0, 1, 2), F.lit(False))
    records = (
        _items(spark, sf_dir)
        .select(*_KEYS, _repository(), *_marks())
        .filter(usable)
        .select("repository", F.lit(1).alias("part"), *_KEYS)
    )
    ends = (
        records.select("repository")
        .distinct()
        .select("repository", F.explode(F.array(F.lit(0), F.lit(2))).alias("part"))
    )
    # the order of their paths, in which keys without a value are left out
    given = F.array_compact(F.array(*(F.col(c).cast("bigint") for c in _KEYS)))
    paths = [
        F.coalesce(*_KEYS).asc_nulls_first(),
        *(F.get(given, F.lit(n)).asc_nulls_last() for n in range(1, len(_KEYS))),
    ]
    sorted_keys = (
        records.unionByName(ends, allowMissingColumns=True)
        .repartition(REPORT_TASKS, "repository")
        .sortWithinPartitions("repository", "part", *paths)
    )
    # plain projections, as they keep the order that the writer needs
    record = F.concat(F.lit(","), F.expr("substr(value, 2, length(value) - 2)"))
    return (
        sorted_keys.select("*", *_marks())
        .withColumn("base", _base())
        .withColumn("value", report)
        .select(
            "repository",
            F.when(F.col("part") == 0, "[7").when(F.col("part") == 2, "]").otherwise(record)
            .alias("value"),
        )
    )


def all_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        gitleaks_reports(spark, sf_dir)
        .unionByName(trufflehog_reports(spark, sf_dir))
        .unionByName(detect_secrets_reports(spark, sf_dir))
        .unionByName(titus_reports(spark, sf_dir))
    )


def _event_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        "event_id",
        (F.col("user_id") % 8).alias("rr"),
        F.concat(F.lit("repo-"), _text(F.col("user_id") % 8)).alias("repository"),
        F.md5(_text(F.col("event_id") * 7 % 400)).alias("blob_id"),
        F.concat(F.lit("src/e"), _text(F.col("event_id") % 97), F.lit(".py")).alias("path"),
    )


def provenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blob provenance of half the repositories; every ninth path is empty."""
    return (
        _event_marks(spark, sf_dir)
        .filter(F.col("rr") < 4)
        .select(
            "repository",
            "blob_id",
            F.when(F.col("event_id") % 9 == 0, "").otherwise(F.col("path")).alias("path"),
            F.col("event_id").alias("seq"),
        )
    )


def absolute_provenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same paths below each repository's folder."""
    whole = F.concat(F.lit("/srv/"), "repository", F.lit("/"), "path")
    return provenance(spark, sf_dir).withColumn(
        "path", F.when(F.col("path") != "", whole).otherwise("")
    )


def repository_roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        _event_marks(spark, sf_dir)
        .select("repository")
        .distinct()
        .select(
            "repository",
            F.concat(F.lit("/srv/"), "repository").alias("absolute_root"),
            F.col("repository").alias("given_root"),
        )
    )


def estate_blame(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blamed ranges of the files that blobs name. Every fourth file has left the head: it is
    blamed at the first revision, and wrongly at a later one."""
    number = F.regexp_extract("path", "([0-9]+)", 1).cast("int")
    ranges = F.array(
        *(
            F.struct(F.lit(a).alias("line_start"), F.lit(b).alias("line_end"), F.lit(n).alias("n"))
            for n, (a, b) in enumerate([(1, 10), (11, 2_000_000_000)])
        )
    )
    right = F.md5(F.concat_ws("-", "path", _text(F.col("r.n"))))
    gone = number % 4 == 0
    at = F.when(
        gone,
        F.array(
            F.struct(_first_revision().alias("revision"), right.alias("commit")),
            F.struct(_later_revision().alias("revision"), F.lit("wrong").alias("commit")),
        ),
    ).otherwise(F.array(F.struct(F.lit("HEAD").alias("revision"), right.alias("commit"))))
    return (
        _event_marks(spark, sf_dir)
        .select("repository", "path")
        .distinct()
        .select("repository", "path", F.explode(ranges).alias("r"))
        .select("repository", "path", "r", F.explode(at).alias("a"))
        .select(
            "repository",
            "a.revision",
            F.col("path").alias("file_path"),
            "r.line_start",
            "r.line_end",
            F.col("a.commit").alias("commit_hash"),
        )
    )


def _first_revision() -> Column:
    return F.md5(F.concat(F.lit("first-"), "repository"))


def _later_revision() -> Column:
    return F.md5(F.concat(F.lit("later-"), "repository"))


def estate_blob_commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two commits of every blob."""
    both = F.array(
        F.struct(_later_revision().alias("commit_hash"), F.lit(10**9).alias("late")),
        F.struct(_first_revision().alias("commit_hash"), F.lit(0).alias("late")),
    )
    return (
        _event_marks(spark, sf_dir)
        .select("repository", "blob_id", "event_id", F.explode(both).alias("c"))
        .select(
            "repository",
            "blob_id",
            "c.commit_hash",
            F.timestamp_seconds(F.col("event_id") + F.col("c.late")).alias("commit_ts"),
        )
    )


def report_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text report lines of all repositories: files, blobs, colours and other text."""
    kind = F.col("event_id") % 5
    return _event_marks(spark, sf_dir).select(
        "repository",
        F.col("event_id").alias("line_no"),
        F.when(kind == 0, F.concat(F.lit("\x1b[1;32m  File: "), "path", F.lit("\x1b[0m ")))
        .when(kind == 1, F.lit("Rule: np.aws.6"))
        .otherwise(F.concat(F.lit("  Blob: "), "blob_id"))
        .alias("line"),
    )


def _part_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys of all parts, of which a task has a bounded number, as each becomes 24 rows."""
    keys = table(spark, sf_dir, "part").select("p_partkey")
    tasks = max(spark.sparkContext.defaultParallelism, keys.count() // PARTS_A_TASK)
    return keys.repartition(tasks, "p_partkey")


def blame_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blamed line ranges of one file per part and repository; some files left the head."""
    pk = F.col("p_partkey")
    segment = F.explode(
        F.array(
            *(
                F.struct(
                    F.lit(a).alias("line_start"), F.lit(b).alias("line_end"),
                    F.lit(n).alias("segment"),
                )
                for n, (a, b) in enumerate([(1, 10), (11, 40), (41, 300)])
            )
        )
    )
    return (
        _part_keys(spark, sf_dir)
        .select("p_partkey", F.explode(F.sequence(F.lit(0), F.lit(7))).alias("rr"))
        .select("p_partkey", "rr", segment.alias("range"))
        .select(
            F.concat(F.lit("repo-"), _text(F.col("rr"))).alias("repository"),
            F.when(pk % 4 == 0, F.md5(F.concat(F.lit("c1-"), _text(pk)))).otherwise("HEAD")
            .alias("revision"),
            F.concat(F.lit("src/p"), _text(pk), F.lit(".py")).alias("file_path"),
            "range.line_start",
            "range.line_end",
            F.md5(F.concat_ws("-", _text(pk), _text(F.col("range.segment")))).alias(
                "commit_hash"
            ),
        )
    )


def blob_commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three commits per part, repository and blob; ``c1`` is the earliest."""
    pk = F.col("p_partkey")
    return (
        _part_keys(spark, sf_dir)
        .select("p_partkey", F.explode(F.sequence(F.lit(0), F.lit(7))).alias("rr"))
        .select("p_partkey", "rr", F.explode(F.sequence(F.lit(1), F.lit(3))).alias("n"))
        .select(
            F.concat(F.lit("repo-"), _text(F.col("rr"))).alias("repository"),
            F.md5(F.concat(F.lit("b"), _text(pk))).alias("blob_id"),
            F.md5(F.concat(F.lit("c"), _text(F.col("n")), F.lit("-"), _text(pk))).alias(
                "commit_hash"
            ),
            F.timestamp_seconds(F.lit(1_700_000_000) + F.col("n") * 60 + pk).alias("commit_ts"),
        )
    )


def unattributed_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings with a blob but no commit; some without file, some past the last line."""
    pk = _text(F.col("pk"))
    path = F.when(F.col("ln") == 7, "").otherwise(
        F.concat(F.lit("src/p"), pk, F.lit(".py"))
    )
    return (
        _marked(spark, sf_dir)
        .select(
            "repository",
            path.alias("file_path"),
            (F.col("ok") % 350 + 1).cast("int").alias("line_number"),
            F.lit("AWS Key").alias("secret_type"),
            F.col("base").alias("secret_value"),
            F.lit("").alias("commit_hash"),
            F.array(F.lit("titus")).alias("found_by"),
            F.md5(F.concat(F.lit("b"), pk)).alias("blob_id"),
            F.struct("ok", "ln", "pk", "sk").alias("seq"),
        )
        .withColumn(
            "id", finding_id(F.col("repository"), F.col("file_path"), F.col("secret_value"))
        )
    )


def document_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files of their source, at a revision named by their content."""
    return table(spark, sf_dir, "documents").select(
        F.col("source").alias("repository"),
        F.concat(F.lit("doc-"), _text(F.col("doc_id"))).alias("file_path"),
        F.md5("text").alias("commit_hash"),
        "text",
    )


def page_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as files of their host, with quotes unescaped."""
    return table(spark, sf_dir, "pages").select(
        F.regexp_extract("url", "^[a-z]+://([^/]+)", 1).alias("repository"),
        F.concat(F.lit("page-"), _text(F.col("page_id"))).alias("file_path"),
        F.md5("html").alias("commit_hash"),
        F.replace("html", F.lit("&quot;"), F.lit('"')).alias("text"),
    )


def conversation_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversation turns as files of their role."""
    return table(spark, sf_dir, "conversations").select(
        F.col("role").alias("repository"),
        F.concat_ws("-", F.lit("conv"), _text(F.col("conv_id")), _text(F.col("turn"))).alias(
            "file_path"
        ),
        F.md5("text").alias("commit_hash"),
        "text",
    )


def key_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents followed by two private keys of their own, the second with other line ends."""

    def part(letter: str) -> Column:
        return F.md5(F.concat(_text(F.col("doc_id")), F.lit(letter)))

    keys = F.concat(
        F.lit("\n-----BEGIN RSA PRIVATE KEY-----\n"), part("a"), F.lit("\n"), part("b"),
        F.lit("\n-----END RSA PRIVATE KEY-----\nbetween\n-----BEGIN PRIVATE KEY-----\r\n"),
        part("c"), F.lit("\r\n-----END PRIVATE KEY-----"),
    )
    return table(spark, sf_dir, "documents").select(
        F.col("source").alias("repository"),
        F.concat(F.lit("doc-"), _text(F.col("doc_id"))).alias("file_path"),
        F.md5(_text(F.col("doc_id"))).alias("commit_hash"),
        F.concat("text", keys).alias("text"),
    )


def document_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document at two commits with the same content, the later one listed as well."""
    doc = F.col("doc_id")
    return (
        table(spark, sf_dir, "documents")
        .select("source", "doc_id", "text", F.explode(F.array(F.lit(2), F.lit(1))).alias("n"))
        .select(
            F.col("source").alias("repository"),
            F.concat(F.lit("file-"), _text(doc % 50)).alias("file_path"),
            F.md5(F.concat_ws("-", _text(doc), _text(F.col("n")))).alias("commit_hash"),
            (doc * 10 + F.col("n")).alias("commit_ts"),
            "text",
        )
    )


def encoded_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base64 texts: sound, unpadded, with foreign characters, broken, trailing, bad UTF-8."""
    encoded = _b64(F.col("base"))
    form = F.col("ok") % 8
    value = (
        F.when(form == 0, encoded)
        .when(form == 1, F.rtrim(encoded, F.lit("=")))
        .when(form == 2, F.concat(F.left(encoded, F.lit(5)), F.lit("-\n *"),
                                  F.substr(encoded, F.lit(6))))
        .when(form == 3, "not base64!")
        .when(form == 4, "")
        .when(form == 5, F.concat(encoded, F.lit("QUJD")))
        .when(form == 6, "/0E=")
        .otherwise(F.concat(F.lit("="), encoded))
    )
    return _marked(spark, sf_dir).select("ok", "ln", value.alias("encoded"))


def awkward_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values with all kinds of white space, assignments, quotes and padding."""
    base, form = F.col("base"), F.col("ok") % 12
    value = F.element_at(
        F.array(
            base,
            F.concat(F.lit(" "), base, F.lit("\t\r\n ")),
            F.concat(F.left(base, F.lit(9)), F.lit("\\n\u00a0\u2003\x1c\x0b"),
                     F.substr(base, F.lit(10))),
            F.concat(F.lit("AWS_KEY="), base),
            F.concat(F.lit("$variable = '"), base, F.lit("';")),
            F.concat(F.lit("'key' => '"), base, F.lit("'")),
            F.lit("PASSWORD="),
            _b64(base),
            F.concat(F.lit("C:\\new\\"), base),
            F.concat(F.lit("\\ n"), base, F.lit("\\\n n")),
            F.concat(F.lit('"a.b->c()" => "'), base, F.lit('" ; ,$')),
            F.concat(F.lit("\x85\u3000\u1680"), base, F.lit("\u200b")),
        ),
        (form + 1).cast("int"),
    )
    return _marked(spark, sf_dir).select(
        "repository",
        F.concat(F.lit("src/f"), _text(F.col("kk") % 40), F.lit(".py")).alias("file_path"),
        value.alias("secret_value"),
    )


def value_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two values per line item: contexts of one secret, or of two different ones."""
    base, form = F.col("base"), F.col("ok") % 6
    other = F.md5(_text(F.col("kk") + 1))
    b = F.element_at(
        F.array(
            base,
            F.concat(F.lit('"aws_key" = "'), base, F.lit('";')),
            F.concat(base, F.lit("\\nS3_SECRET="), other),
            other,
            F.lit("PASSWORD="),
            F.concat(F.left(base, F.lit(12)), F.lit("="), other),
        ),
        (form + 1).cast("int"),
    )
    a = F.when(F.col("ln") % 2 == 0, F.concat(F.lit("AWS_KEY="), base)).otherwise(base)
    return _marked(spark, sf_dir).select(a.alias("a"), b.alias("b"))


def rooted_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths below the absolute root, below the root as given, next to it and relative."""
    name = F.concat(F.lit("src/f"), _text(F.col("kk")), F.lit(".py"))
    given = F.concat(F.lit("work/"), F.col("repository"))
    absolute = F.concat(F.lit("/srv/"), given)
    form = F.col("ok") % 5
    path = (
        F.when(form == 0, F.concat(absolute, F.lit("/"), name))
        .when(form == 1, F.concat(given, F.lit("//"), name))
        .when(form == 2, F.concat(absolute, F.lit("-copy/"), name))
        .when(form == 3, name)
        .otherwise(absolute)
    )
    return _marked(spark, sf_dir).select(
        path.alias("path"), absolute.alias("absolute_root"), given.alias("given_root")
    )
