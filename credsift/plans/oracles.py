"""The queries again as DuckDB SQL over the same tables.

Raw reports are not rebuilt here: each statement derives the expected findings directly from
the tables the reports were made of.
"""

from __future__ import annotations

ORACLES: dict[str, str] = {}

SPACE = r"[\s\x0b\x1c-\x1f\x85\p{Z}]"
COLUMNS = "id, repository, file_path, line_number, secret_type, secret_value, commit_hash"


def without_space(value: str) -> str:
    return f"regexp_replace({value}, '{SPACE}+', '', 'g')"


def strip_space(value: str) -> str:
    return f"regexp_replace({value}, '^{SPACE}+|{SPACE}+$', '', 'g')"


def norm(value: str) -> str:
    return without_space(f"replace({value}, '\\n', '')")


def core(normal: str) -> str:
    return (
        f"""trim(regexp_replace({normal}, '^[''"$]*[A-Za-z0-9_>().\\-]*=>?[''"]?', ''), """
        """'''";$, ')"""
    )


def finding_id(repository: str, path: str, value: str) -> str:
    return f"sha256({repository} || '|' || {path} || '|' || {without_space(value)})"


def flat(source: str) -> str:
    return f"SELECT {COLUMNS}, array_to_string(found_by, ',') AS found_by FROM {source}"


def marked(secrets: int = 400, repos: int = 8) -> str:
    return f"""marked AS (
  SELECT l_orderkey AS ok, l_linenumber AS ln, l_partkey AS pk, l_suppkey AS sk,
         l_partkey % {secrets} AS kk, 'repo-' || (l_suppkey % {repos}) AS repository,
         l_orderkey % 4 AS tt, l_orderkey % 20 AS shape,
         'AKIA' || upper(substr(md5(CAST(l_partkey % {secrets} AS VARCHAR)), 1, 16)) AS base,
         row(l_orderkey, l_linenumber, l_partkey, l_suppkey) AS run
  FROM lineitem)"""


def found(secrets: int = 400, repos: int = 8) -> str:
    """CTEs up to ``found``: the line item findings."""
    return f"""{marked(secrets, repos)},
valued AS (
  SELECT repository, run AS seq,
    CASE WHEN tt = 3 AND ok % 3 = 0 THEN ''
         WHEN ln >= 6 THEN 'test/f' || (kk % 40) || '.py'
         ELSE 'src/f' || (kk % 40) || '.py' END AS file_path,
    CASE WHEN tt = 3 AND ok % 3 = 0 THEN NULL
         ELSE CAST(kk % 30 + 1 AS INTEGER) END AS line_number,
    ['aws-access-token', 'AWS', 'Secret Keyword', 'AWS API Credentials'][tt + 1] AS secret_type,
    [base, substr(base, 1, 8) || chr(10) || substr(base, 9),
     '"aws_key" = "' || base || '";', 'AWS_KEY=' || base][tt + 1] AS secret_value,
    CASE WHEN tt = 3 AND ok % 3 = 0 THEN ''
         ELSE md5(CAST(kk % 50 AS VARCHAR)) END AS commit_hash,
    [['gitleaks', 'trufflehog', 'detect-secrets', 'titus'][tt + 1]] AS found_by
  FROM marked),
found AS (
  SELECT {finding_id('repository', 'file_path', 'secret_value')} AS id, *,
         {norm('secret_value')} AS norm
  FROM valued)"""


def merge(source: str, keys: str) -> str:
    """One finding per key: the best row, blanks filled, tools united, first arrival kept."""
    return f"""
  SELECT best.id AS id, best.repository AS repository, best.file_path AS file_path,
         coalesce(best.line_number, first_line) AS line_number,
         best.secret_type AS secret_type, best.secret_value AS secret_value,
         CASE WHEN best.commit_hash <> '' THEN best.commit_hash
              ELSE coalesce(first_commit, '') END AS commit_hash,
         found_by, seq, {norm('best.secret_value')} AS norm
  FROM (
    SELECT arg_min(struct_pack(id := id, repository := repository, file_path := file_path,
             line_number := line_number, secret_type := secret_type,
             secret_value := secret_value, commit_hash := commit_hash),
             row(file_path = '', commit_hash = '', line_number IS NULL, -length(norm), seq))
             AS best,
           arg_min(commit_hash, seq) FILTER (commit_hash <> '') AS first_commit,
           arg_min(line_number, seq) FILTER (line_number IS NOT NULL) AS first_line,
           list_sort(list_distinct(flatten(list(found_by)))) AS found_by,
           min(seq) AS seq
    FROM {source} GROUP BY {keys})"""


def absorb(source: str, use_core: bool = True) -> str:
    """Ordered fold per location; rows without a location pass through."""
    union = "list_sort(list_distinct(list_concat(s.found_by, st.cur.found_by)))"

    def united(longer: str) -> str:
        parts = ", ".join(f"{c} := {longer}.{c}" for c in ("rank", "norm", "core", "line"))
        return f"struct_pack({parts}, found_by := {union})"

    return f"""
  SELECT {COLUMNS}, found_by FROM {source}
  WHERE file_path = '' OR line_number IS NULL OR commit_hash = ''
  UNION ALL
  SELECT item.line.id, item.line.repository, item.line.file_path, item.line.line_number,
         item.line.secret_type, item.line.secret_value, item.line.commit_hash, item.found_by
  FROM (
    SELECT unnest(list_reduce(items, lambda acc, x:
      CASE WHEN len(list_filter(acc, lambda s:
             contains(s.norm, x.core) OR contains(x.norm, s.core))) = 0
      THEN list_append(acc, x)
      ELSE list_transform([list_reduce(acc, lambda st, s:
        CASE WHEN st.placed THEN struct_pack(kept := list_append(st.kept, s),
                                             cur := st.cur, placed := true)
        WHEN contains(s.norm, st.cur.core) THEN struct_pack(
          kept := list_append(st.kept, CASE WHEN s.rank <= st.cur.rank THEN {united('s')}
                                            ELSE {united('st.cur')} END),
          cur := st.cur, placed := true)
        WHEN contains(st.cur.norm, s.core) THEN struct_pack(
          kept := st.kept, cur := CASE WHEN st.cur.rank <= s.rank THEN {united('st.cur')}
                                       ELSE {united('s')} END, placed := false)
        ELSE struct_pack(kept := list_append(st.kept, s), cur := st.cur, placed := false) END,
        struct_pack(kept := acc[1:0], cur := x, placed := false))],
        lambda r: CASE WHEN r.placed THEN r.kept ELSE list_append(r.kept, r.cur) END)[1]
      END, items[1:0])) AS item
    FROM (
      SELECT list(struct_pack(rank := -length(norm), norm := norm,
               core := {core('norm') if use_core else 'norm'},
               line := struct_pack(id := id, repository := repository, file_path := file_path,
                 line_number := line_number, secret_type := secret_type,
                 secret_value := secret_value, commit_hash := commit_hash),
               found_by := found_by) ORDER BY -length(norm), seq) AS items
      FROM {source}
      WHERE file_path <> '' AND line_number IS NOT NULL AND commit_hash <> ''
      GROUP BY repository, file_path, line_number, commit_hash))"""


def passes(source: str = "found") -> str:
    return f"""pass1 AS ({merge(source, 'id')}),
pass2 AS ({merge('pass1', 'repository, norm')}),
pass3 AS ({absorb('pass2')})"""


FOUND = found()
DEDUP = f"WITH {FOUND},\n{passes()}\n"

# readers

GITLEAKS = f"""gitleaks AS (
  SELECT {finding_id('repository', 'file_path', 'secret_value')} AS id, *,
         ['gitleaks'] AS found_by
  FROM (
    SELECT repository, 'src/f' || (kk % 40) || '.py' AS file_path,
           CAST(kk % 30 + 1 AS INTEGER) AS line_number, 'aws-access-token' AS secret_type,
           base AS secret_value, md5(CAST(kk % 50 AS VARCHAR)) AS commit_hash,
           row(0, run, '', 0, 0) AS seq
    FROM marked WHERE shape > 2
    UNION ALL
    SELECT repository, CASE WHEN ln = 1 THEN 'test/f' || (kk % 40) || '.py' ELSE '' END, NULL,
           CASE WHEN ln = 1 THEN 'Unknown' END,
           CASE WHEN ln = 1 THEN '' ELSE substr(base, 1, 8) || chr(10) || '  ' || substr(base, 9)
           END, '', row(0, run, '', 1, 0)
    FROM marked WHERE shape > 2 AND ln <> 7))"""

TRUFFLEHOG = f"""trufflehog AS (
  SELECT {finding_id('repository', 'file_path', 'secret_value')} AS id, *,
         ['trufflehog'] AS found_by
  FROM (
    SELECT repository,
      CASE WHEN shape = 7 THEN '' WHEN shape = 9 THEN 'a.py'
           ELSE 'src/f' || (kk % 40) || '.py' END AS file_path,
      CASE WHEN shape IN (7, 9) THEN NULL ELSE CAST(kk % 30 + 1 AS INTEGER) END AS line_number,
      CASE WHEN shape = 7 THEN 'Unknown' WHEN shape = 9 THEN NULL ELSE 'AWS' END AS secret_type,
      CASE WHEN shape = 5 THEN substr(base, 1, 6) || '***'
           ELSE substr(base, 1, 8) || chr(10) || substr(base, 9) END AS secret_value,
      CASE WHEN shape IN (7, 9) THEN '' ELSE md5(CAST(kk % 50 AS VARCHAR)) END AS commit_hash,
      row(1, run, '', 0, 0) AS seq
    FROM marked WHERE shape > 8 OR shape IN (5, 7)))"""


def detect_secrets(with_lines: bool) -> str:
    digest = "md5(CAST(kk AS VARCHAR))"
    # a source line exists for two thirds of the secrets; several secrets can share a line
    value = "coalesce(line, digest)" if with_lines else "digest"
    join = """
    LEFT JOIN (
      SELECT repository, 'src/f' || (kk % 40) || '.py' AS file_path,
             kk % 30 + 1 AS line_number,
             min('"aws_key" = "' || base || '";') AS line
      FROM marked WHERE kk % 3 <> 0 GROUP BY ALL) USING (repository, file_path, line_number)"""
    return f"""detected AS (
  SELECT {finding_id('repository', 'file_path', 'secret_value')} AS id, *,
         ['detect-secrets'] AS found_by
  FROM (
    SELECT repository, file_path, CAST(line_number AS INTEGER) AS line_number, secret_type,
           {value} AS secret_value, '' AS commit_hash, seq
    FROM (
      SELECT repository, 'src/f' || (kk % 40) || '.py' AS file_path, kk % 30 + 1 AS line_number,
             'Secret Keyword' AS secret_type, {digest} AS digest,
             row(2, run, 'src/f' || (kk % 40) || '.py', 0, 0) AS seq
      FROM marked WHERE shape > 3
      UNION ALL
      SELECT repository, 'test/f' || (kk % 40) || '.py', 3, 'Unknown', {digest},
             row(2, run, 'test/f' || (kk % 40) || '.py', 0, 0)
      FROM marked WHERE shape > 3){join if with_lines else ''}))"""


MARKS = """marks AS (
  SELECT event_id, user_id % 8 AS rr, 'repo-' || (user_id % 8) AS repository,
         md5(CAST(event_id * 7 % 400 AS VARCHAR)) AS blob_id,
         'src/e' || (event_id % 97) || '.py' AS path
  FROM events),
blob_first AS (
  SELECT repository, blob_id, arg_min(path, event_id) AS path FROM marks
  WHERE rr < 4 AND event_id % 9 <> 0 GROUP BY repository, blob_id),
blob_last AS (
  SELECT repository, blob_id, arg_max(current, event_id) AS path
  FROM (SELECT *, last_value(CASE WHEN event_id % 5 = 0 THEN path END IGNORE NULLS) OVER (
          PARTITION BY repository ORDER BY event_id
          ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS current FROM marks)
  WHERE event_id % 5 > 1 AND current IS NOT NULL GROUP BY repository, blob_id),
blob_paths AS (
  SELECT * FROM blob_first
  UNION ALL
  SELECT * FROM blob_last WHERE repository NOT IN (SELECT repository FROM blob_first))"""


def titus(with_paths: bool) -> str:
    path = "coalesce(path, '')" if with_paths else "''"
    join = "LEFT JOIN blob_paths USING (repository, blob_id)" if with_paths else ""
    return f"""grouped AS (
  SELECT repository, '' AS file_path, CAST(NULL AS INTEGER) AS line_number,
         CASE WHEN shape < 10 THEN 'np.aws.1' ELSE 'Unknown' END AS secret_type,
         base AS secret_value, '' AS commit_hash, row(3, run, '', 1, 0) AS seq
  FROM marked WHERE shape > 3),
titus AS (
  SELECT {finding_id('repository', 'file_path', 'secret_value')} AS id, *, ['titus'] AS found_by
  FROM (
    SELECT repository, {path} AS file_path, line_number, secret_type, secret_value,
           '' AS commit_hash, seq
    FROM (
      SELECT repository, md5(CAST(kk AS VARCHAR)) AS blob_id,
             CAST(kk % 30 + 1 AS INTEGER) AS line_number, 'AWS Key' AS secret_type,
             'AWS_KEY=' || base AS secret_value, row(3, run, '', 0, 0) AS seq
      FROM marked WHERE shape > 2
      UNION ALL
      SELECT repository, md5(CAST(kk AS VARCHAR)), NULL, 'AWS API Credentials', base,
             row(3, run, '', 0, 1)
      FROM marked WHERE shape > 2) {join}
    UNION ALL SELECT * FROM grouped))"""


ALL_TOOLS = f"""{marked()}, {MARKS}, {GITLEAKS}, {TRUFFLEHOG}, {detect_secrets(True)},
{titus(True)},
everything AS (
  SELECT {COLUMNS}, found_by, seq FROM gitleaks
  UNION ALL SELECT {COLUMNS}, found_by, seq FROM trufflehog
  UNION ALL SELECT {COLUMNS}, found_by, seq FROM detected
  UNION ALL SELECT {COLUMNS}, found_by, seq FROM titus),
found AS (SELECT *, {norm('secret_value')} AS norm FROM everything)"""

ORACLES["gitleaks_report"] = f"WITH {marked()}, {GITLEAKS} {flat('gitleaks')}"
ORACLES["trufflehog_report"] = f"WITH {marked()}, {TRUFFLEHOG} {flat('trufflehog')}"
ORACLES["trufflehog_raw_or_redacted"] = f"""WITH {marked()}, {TRUFFLEHOG}
SELECT repository, secret_value LIKE '%***' AS redacted, count(*) AS findings,
       min(secret_value) AS smallest
FROM trufflehog GROUP BY ALL"""
ORACLES["detect_secrets_report"] = f"WITH {marked()}, {detect_secrets(False)} {flat('detected')}"
ORACLES["detect_secrets_line_lookup"] = (
    f"WITH {marked()}, {detect_secrets(True)} {flat('detected')}"
)
ORACLES["titus_report"] = f"WITH {marked()}, {titus(False)} {flat('titus')}"
ORACLES["titus_groups_fallback"] = f"""WITH {marked()}, {titus(False)}
SELECT {finding_id('repository', 'file_path', 'secret_value')} AS id,
       * EXCLUDE (seq), 'titus' AS found_by FROM grouped"""
ORACLES["titus_blob_join"] = f"WITH {marked()}, {MARKS}, {titus(True)} {flat('titus')}"
ORACLES["b64_decode"] = f"""WITH {marked()},
encoded AS (SELECT ok, ln, base, to_base64(base::BLOB) AS b64 FROM marked)
SELECT ok, ln,
  CASE ok % 8 WHEN 0 THEN b64 WHEN 1 THEN rtrim(b64, '=')
    WHEN 2 THEN substr(b64, 1, 5) || '-' || chr(10) || ' *' || substr(b64, 6)
    WHEN 3 THEN 'not base64!' WHEN 4 THEN '' WHEN 5 THEN b64 || 'QUJD' WHEN 6 THEN '/0E='
    ELSE '=' || b64 END AS encoded,
  CASE ok % 8 WHEN 1 THEN rtrim(b64, '=') WHEN 3 THEN 'not base64!' WHEN 4 THEN ''
    WHEN 6 THEN chr(65533) || 'A' ELSE base END AS decoded
FROM encoded"""
ORACLES["blob_path_first"] = f"WITH {MARKS} SELECT * FROM blob_first"
ORACLES["blob_path_ffill"] = f"WITH {MARKS} SELECT * FROM blob_last"
ORACLES["blob_path_fallback"] = f"WITH {MARKS} SELECT * FROM blob_paths"
ORACLES["repositories"] = "SELECT DISTINCT 'repo-' || (l_suppkey % 8) AS repository FROM lineitem"
_GITLEAKS_TITUS = f"""{marked()}, {MARKS}, {GITLEAKS}, {titus(True)},
everything AS (
  SELECT {COLUMNS}, found_by, seq FROM gitleaks
  UNION ALL SELECT {COLUMNS}, found_by, seq FROM titus),
normed AS (SELECT *, {norm('secret_value')} AS norm FROM everything)"""
ORACLES["repository_reports"] = f"WITH {_GITLEAKS_TITUS} {flat('everything')}"
ORACLES["listed_repositories"] = """
SELECT DISTINCT 'repo-' || (l_suppkey % 8) AS repository, 'gitleaks' AS tool,
       CAST(1 AS BIGINT) AS reports
FROM lineitem"""
ORACLES["streaming_estate"] = f"""WITH {_GITLEAKS_TITUS},
merged AS ({merge('normed', 'id')})
{flat('merged')}"""
ORACLES["tool_selection"] = f"""WITH {marked()}
SELECT tool, repository, count(*) AS reports
FROM marked, (VALUES ('gitleaks'), ('titus')) AS t(tool) GROUP BY ALL"""
ORACLES["missing_report"] = f"""WITH {marked()}, {GITLEAKS}
SELECT repository, count(*) AS gitleaks, CAST(0 AS BIGINT) AS trufflehog,
       CAST(0 AS BIGINT) AS detect_secrets, CAST(0 AS BIGINT) AS titus
FROM gitleaks GROUP BY repository"""
ORACLES["rejects"] = f"""WITH {marked()},
bad AS (
  SELECT repository, 'gitleaks' AS tool,
    CASE WHEN shape = 0 THEN 'broken json' WHEN shape = 1 THEN 'not an array'
         WHEN shape > 2 AND ln = 7 THEN 'unusable record' END AS reason FROM marked
  UNION ALL
  SELECT repository, 'trufflehog',
    CASE shape WHEN 0 THEN 'broken json' WHEN 1 THEN 'not an object'
         WHEN 6 THEN 'unusable path' WHEN 8 THEN 'unusable secret' END FROM marked
  UNION ALL
  SELECT repository, 'detect-secrets',
    CASE shape WHEN 1 THEN 'not an object' WHEN 2 THEN 'broken json' WHEN 3 THEN 'no results'
         WHEN 0 THEN NULL ELSE 'unusable record' END FROM marked
  UNION ALL
  SELECT repository, 'titus',
    CASE shape WHEN 0 THEN 'broken json' WHEN 1 THEN 'not an array' WHEN 2 THEN NULL
         ELSE 'unusable record' END FROM marked
  UNION ALL
  SELECT repository, 'titus', 'unusable record' FROM marked WHERE shape = 3)
SELECT repository, tool, reason, count(*) AS rows FROM bad WHERE reason IS NOT NULL GROUP BY ALL"""
ORACLES["union_all_tools"] = f"""WITH {ALL_TOOLS}
SELECT repository, found_by[1] AS tool, count(*) AS findings, count(DISTINCT id) AS ids,
       min(id) AS first_id, max(id) AS last_id
FROM everything GROUP BY ALL"""
ORACLES["raw_landing"] = f"""WITH {marked()},
parts AS (
  SELECT *, md5(CAST(kk AS VARCHAR)) AS digest, md5(CAST(kk % 50 AS VARCHAR)) AS commit_hash,
    to_base64(base::BLOB) AS base64, to_base64(('AWS_KEY=' || base)::BLOB) AS named64,
    to_base64(('  ' || base || chr(10))::BLOB) AS padded64
  FROM marked),
pieces AS (
  SELECT *,
    '{{"Description": "AWS Access Key", "StartLine": ' || (kk % 30 + 1) || ', "File": "src/f' ||
      (kk % 40) || '.py", "Commit": "' || commit_hash || '", "Secret": "' || base ||
      '", "RuleID": "aws-access-token"}}' AS g1,
    CASE WHEN ln = 1 THEN '{{"File": "test/f' || (kk % 40) || '.py", "Secret": ""}}'
         WHEN ln = 7 THEN '7'
         ELSE '{{"File": null, "StartLine": 0, "RuleID": null, "Secret": "' ||
              substr(base, 1, 8) || '\\n  ' || substr(base, 9) || '"}}' END AS g2,
    '{{"Data": {{"Git": {{"file": "src/f' || (kk % 40) || '.py", "commit": "' || commit_hash ||
      '", "line": ' || (kk % 30 + 1) || '}}}}}}' AS git,
    '"Raw": "' || substr(base, 1, 8) || '\\n' || substr(base, 9) || '"' AS raw,
    '"Redacted": "' || substr(base, 1, 6) || '***"' AS redacted,
    '{{"RuleID": "np.aws.6", "RuleName": "AWS API Credentials", "Groups": ["' || base64 ||
      '"], "Matches": [{{"BlobID": "' || digest ||
      '", "RuleName": "AWS Key", "Snippet": {{"Matching": "' || named64 ||
      '"}}, "Location": {{"Source": {{"Start": {{"Line": ' || (kk % 30 + 1) ||
      '}}}}}}}}, {{"BlobID": "' || digest || '", "RuleName": "", "Snippet": {{"Matching": "' ||
      padded64 || '"}}, "Location": {{}}}}, {{"BlobID": "' || digest ||
      '", "Snippet": {{"Matching": "IA=="}}}}, {{"Snippet": null}}]}}' AS matched,
    '{{' || CASE WHEN shape < 10 THEN '"RuleID": "np.aws.1", ' ELSE '' END ||
      '"RuleName": null, "Groups": ["' || base64 || '"], "Matches": ' ||
      CASE WHEN shape % 2 = 0 THEN 'null' ELSE '[]' END || '}}' AS grouped
  FROM parts),
reports AS (
  SELECT repository, 'gitleaks' AS tool,
    CASE shape WHEN 0 THEN '{{corrupt' WHEN 1 THEN g1 WHEN 2 THEN '[]'
      ELSE '[' || chr(10) || g1 || ',' || chr(10) || g2 || chr(10) || ']' END AS value
  FROM pieces
  UNION ALL
  SELECT repository, 'trufflehog',
    CASE shape WHEN 0 THEN '{{"bad json' WHEN 2 THEN '   ' WHEN 7 THEN '{{' || raw || '}}'
      ELSE CASE WHEN shape = 1 THEN '[' ELSE '' END || '{{"SourceMetadata": ' ||
        CASE shape WHEN 6 THEN '{{"Data": {{"Git": null}}}}'
                   WHEN 9 THEN '{{"Data": {{"Git": {{"file": "a.py"}}}}}}' ELSE git END || ', ' ||
        CASE shape WHEN 3 THEN '"Raw": "", ' || redacted WHEN 4 THEN '"Raw": null, ' || redacted
                   WHEN 5 THEN redacted WHEN 8 THEN '"Raw": 12' ELSE raw END ||
        ', "DetectorName": ' || CASE WHEN shape = 9 THEN 'null' ELSE '"AWS"' END || '}}' ||
        CASE WHEN shape = 1 THEN ']' ELSE '' END END
  FROM pieces
  UNION ALL
  SELECT repository, 'detect-secrets',
    CASE shape WHEN 0 THEN '{{"results": {{}}}}' WHEN 1 THEN '[]' WHEN 2 THEN '{{"bad json'
      WHEN 3 THEN '{{"version": "1.0"}}'
      ELSE '{{"results": {{"src/f' || (kk % 40) ||
        '.py": [{{"type": "Secret Keyword", "hashed_secret": "' || digest ||
        '", "line_number": ' || (kk % 30 + 1) || '}}], "test/f' || (kk % 40) ||
        '.py": [{{"hashed_secret": "' || digest ||
        '", "line_number": 3}}, {{"type": "Broken", "line_number": 9}}]}}}}' END
  FROM pieces
  UNION ALL
  SELECT repository, 'titus',
    CASE shape WHEN 0 THEN '{{bad' WHEN 1 THEN matched WHEN 2 THEN '[]'
      WHEN 3 THEN '[' || matched || ', {{"Groups": []}}, 5]'
      ELSE '[' || matched || ', ' || grouped || ']' END
  FROM pieces)
SELECT repository, tool, md5(value) AS digest, CAST(length(value) AS INTEGER) AS chars
FROM reports"""

# scalar functions and keys

AWKWARD = f"""{marked()},
awkward AS (
  SELECT repository, 'src/f' || (kk % 40) || '.py' AS file_path,
    [base,
     ' ' || base || chr(9) || chr(13) || chr(10) || ' ',
     substr(base, 1, 9) || '\\n' || chr(160) || chr(8195) || chr(28) || chr(11) ||
       substr(base, 10),
     'AWS_KEY=' || base,
     '$variable = ''' || base || ''';',
     '''key'' => ''' || base || '''',
     'PASSWORD=',
     to_base64(base::BLOB),
     'C:\\new\\' || base,
     '\\ n' || base || '\\' || chr(10) || ' n',
     '"a.b->c()" => "' || base || '" ; ,$',
     chr(133) || chr(12288) || chr(5760) || base || chr(8203)][ok % 12 + 1] AS secret_value
  FROM marked)"""
ORACLES["normalize_secret"] = f"""WITH {AWKWARD}
SELECT secret_value, {without_space('secret_value')} AS normalized FROM awkward"""
ORACLES["normalize_dedup"] = f"""WITH {AWKWARD}
SELECT secret_value, {norm('secret_value')} AS norm FROM awkward"""
ORACLES["extract_core"] = f"""WITH {AWKWARD}
SELECT secret_value, {core(norm('secret_value'))} AS core FROM awkward"""
ORACLES["finding_id"] = f"""WITH {AWKWARD}
SELECT {finding_id('repository', 'file_path', 'secret_value')} AS id FROM awkward"""
ORACLES["secret_key"] = f"""WITH {AWKWARD}
SELECT sha256(repository || '|' || {norm('secret_value')}) AS secret_key FROM awkward"""
ORACLES["overlap_predicate"] = f"""WITH {marked()},
pairs AS (
  SELECT CASE WHEN ln % 2 = 0 THEN 'AWS_KEY=' || base ELSE base END AS a,
    [base, '"aws_key" = "' || base || '";',
     base || '\\nS3_SECRET=' || md5(CAST(kk + 1 AS VARCHAR)), md5(CAST(kk + 1 AS VARCHAR)),
     'PASSWORD=', substr(base, 1, 12) || '=' || md5(CAST(kk + 1 AS VARCHAR))][ok % 6 + 1] AS b
  FROM marked),
normed AS (SELECT a, b, {norm('a')} AS na, {norm('b')} AS nb FROM pairs)
SELECT a, b,
       na = nb OR contains(nb, na) OR contains(nb, {core('na')}) AS a_in_b,
       na = nb OR contains(na, nb) OR contains(na, {core('nb')}) AS b_in_a
FROM normed"""
ORACLES["relative_path"] = f"""WITH {marked()},
paths AS (
  SELECT 'work/' || repository AS given, '/srv/work/' || repository AS absolute,
    ['/srv/work/' || repository || '/src/f' || kk || '.py',
     'work/' || repository || '//src/f' || kk || '.py',
     '/srv/work/' || repository || '-copy/src/f' || kk || '.py',
     'src/f' || kk || '.py', '/srv/work/' || repository][ok % 5 + 1] AS path
  FROM marked)
SELECT path,
  CASE WHEN starts_with(path, absolute) THEN ltrim(substr(path, length(absolute) + 1), '/')
       WHEN starts_with(path, given) THEN ltrim(substr(path, length(given) + 1), '/')
       ELSE path END AS relative
FROM paths"""

# filters

ORACLES["empty_secret_filter"] = f"""WITH {ALL_TOOLS}
SELECT found_by[1] AS tool, count(*) FILTER (secret_value = '') AS empty,
       count(*) FILTER (secret_value <> '') AS filled
FROM everything WHERE found_by[1] <> 'detect-secrets' GROUP BY ALL"""
ORACLES["has_location"] = f"""WITH {FOUND}
{flat('found')} WHERE file_path <> '' AND line_number IS NOT NULL AND commit_hash <> ''"""

# attribution

BLAME = f"""{marked()},
ranges AS (
  SELECT 'repo-' || rr AS repository,
    CASE WHEN p_partkey % 4 = 0 THEN md5('c1-' || p_partkey) ELSE 'HEAD' END AS revision,
    'src/p' || p_partkey || '.py' AS file_path, first, last,
    md5(p_partkey || '-' || segment) AS blamed
  FROM part, range(8) AS r(rr),
       (VALUES (1, 10, 0), (11, 40, 1), (41, 300, 2)) AS s(first, last, segment)),
blobs AS (
  SELECT 'repo-' || rr AS repository, md5('b' || p_partkey) AS blob_id,
         md5('c' || n || '-' || p_partkey) AS commit_hash,
         1700000000 + n * 60 + p_partkey AS ts
  FROM part, range(8) AS r(rr), range(1, 4) AS c(n)),
first_commits AS (
  SELECT repository, blob_id, arg_min(commit_hash, row(ts, commit_hash)) AS revision
  FROM blobs GROUP BY repository, blob_id),
open AS (
  SELECT repository, CASE WHEN ln = 7 THEN '' ELSE 'src/p' || pk || '.py' END AS file_path,
         CAST(ok % 350 + 1 AS INTEGER) AS line_number, 'AWS Key' AS secret_type,
         base AS secret_value, md5('b' || pk) AS blob_id
  FROM marked),
at_head AS (
  SELECT open.*, coalesce(blamed, '') AS commit_hash
  FROM open LEFT JOIN (SELECT * FROM ranges WHERE revision = 'HEAD') AS h
    ON h.repository = open.repository AND h.file_path = open.file_path
   AND line_number BETWEEN first AND last),
at_first AS (
  SELECT at_head.* EXCLUDE (commit_hash),
    CASE WHEN commit_hash <> '' THEN commit_hash ELSE coalesce(blamed, '') END AS commit_hash
  FROM at_head LEFT JOIN first_commits USING (repository, blob_id)
  LEFT JOIN ranges AS b ON b.repository = at_head.repository
   AND b.revision = first_commits.revision AND b.file_path = at_head.file_path
   AND line_number BETWEEN first AND last)"""


def attributed(source: str) -> str:
    return f"""SELECT {finding_id('repository', 'file_path', 'secret_value')} AS id, repository,
  file_path, line_number, secret_type, secret_value, commit_hash, 'titus' AS found_by
FROM {source}"""


ORACLES["blame_attribution"] = f"WITH {BLAME} {attributed('at_head')}"
ORACLES["blob_first_commit"] = f"WITH {BLAME} SELECT * FROM first_commits"
ORACLES["blame_fallback"] = f"WITH {BLAME} {attributed('at_first')}"

# merging and deduplication

ORACLES["merge_best_row"] = f"""WITH {FOUND},
bare AS (SELECT *, regexp_extract(norm, 'AKIA[0-9A-F]{{16}}') AS bare FROM found),
merged AS ({merge('bare', 'repository, bare')})
{flat('merged')}"""
ORACLES["found_by_union"] = f"""WITH {FOUND}
SELECT repository, file_path,
  array_to_string(list_sort(list_distinct(flatten(list(found_by)))), ',') AS found_by
FROM found GROUP BY repository, file_path"""
ORACLES["dedup_pass1"] = f"{DEDUP}{flat('pass1')}"
ORACLES["dedup_pass2"] = f"{DEDUP}{flat('pass2')}"
ORACLES["dedup_pass3"] = f"{DEDUP}{flat('pass3')}"
ORACLES["dedup_pass3_rounds"] = ORACLES["dedup_pass3"]
ORACLES["dedup_findings"] = ORACLES["dedup_pass3"]
ORACLES["pass3_contained"] = f"""WITH {FOUND},
pass1 AS ({merge('found', 'id')}),
pass2 AS ({merge('pass1', 'repository, norm')}),
whole AS ({absorb('pass2', False)})
{flat('whole')}"""
ORACLES["dedup_many_secrets"] = f"WITH {found(40000, 64)},\n{passes()}\n{flat('pass3')}"
ORACLES["dedup_per_repo"] = f"""{DEDUP}
SELECT repository, count(*) AS findings, min(id) AS first_id, max(id) AS last_id,
       CAST(sum(len(found_by)) AS BIGINT) AS tool_mentions
FROM pass3 GROUP BY repository"""
# the right commit of a line names its file and whether it comes after the tenth line
ORACLES["reports_to_findings"] = f"""WITH {ALL_TOOLS},
blamed AS (
  SELECT * REPLACE (
    CASE WHEN commit_hash = '' AND file_path LIKE 'src/e%' AND line_number IS NOT NULL
         THEN md5(file_path || '-' || CASE WHEN line_number <= 10 THEN 0 ELSE 1 END)
         ELSE commit_hash END AS commit_hash)
  FROM found),
{passes('blamed')}
{flat('pass3')}"""
ORACLES["custom_tool"] = f"""WITH {FOUND},
plain AS (
  SELECT repository, file_path, line_number,
         regexp_replace(secret_value, '[^A-Z0-9]', '', 'g') AS secret_value
  FROM found WHERE line_number IS NOT NULL)
SELECT {finding_id('repository', 'file_path', 'secret_value')} AS id, repository, file_path,
       line_number, 'line' AS secret_type, secret_value, '' AS commit_hash,
       'linescan' AS found_by
FROM plain"""

# reports

ORACLES["summary_by_tool"] = f"""{DEDUP}
SELECT tool, count(*) AS findings FROM (SELECT unnest(found_by) AS tool FROM pass3) GROUP BY tool
UNION ALL SELECT 'total', count(*) FROM pass3"""
ORACLES["distinct_tools"] = f"{DEDUP} SELECT DISTINCT unnest(found_by) AS tool FROM pass3"
ORACLES["reduction_stats"] = f"""{DEDUP}
SELECT repository, raw_findings, unique_findings
FROM (SELECT repository, count(*) AS raw_findings FROM found GROUP BY repository)
JOIN (SELECT repository, count(*) AS unique_findings FROM pass3 GROUP BY repository)
USING (repository)"""
GENERAL = f"{COLUMNS}, array_to_string(found_by, ', ') AS found_by"
ORACLES["report_general"] = f"{DEDUP} SELECT {GENERAL} FROM pass3"
ORACLES["report_tool_tabs"] = f"""{DEDUP}
SELECT {GENERAL}, tool, upper(tool[1]) || lower(tool[2:31]) AS tab
FROM (SELECT *, unnest(found_by) AS tool FROM pass3)"""
ORACLES["report_json"] = ORACLES["dedup_findings"]
ORACLES["report_empty"] = f"{DEDUP} SELECT {GENERAL} FROM pass3 WHERE false"

# streaming: without line and commit, where equal ids differ by the order of dropped files

ORACLES["streaming_ingest"] = f"""WITH {marked()}, {TRUFFLEHOG},
normed AS (SELECT *, {norm('secret_value')} AS norm FROM trufflehog),
merged AS ({merge('normed', 'id')})
{flat('merged')}"""

# scans

BREAK = r"'\r\n|\r|\n'"
TEXTS = """texts AS (
  SELECT source AS repository, 'doc-' || doc_id AS file_path, md5(text) AS commit_hash, text
  FROM documents
  UNION ALL
  SELECT regexp_extract(url, '^[a-z]+://([^/]+)', 1), 'page-' || page_id, md5(html),
         replace(html, '&quot;', '"') FROM pages
  UNION ALL
  SELECT role, 'conv-' || conv_id || '-' || turn, md5(text), text FROM conversations)"""


def lines(source: str) -> str:
    return f"""lines AS (
  SELECT * EXCLUDE (parts), generate_subscripts(parts, 1) AS line_number, unnest(parts) AS line
  FROM (SELECT * EXCLUDE (text), regexp_split_to_array(text, {BREAK}) AS parts FROM {source}))"""


WORDS = "token|secret|password|passwd|api_?key|private_?key"
QUOTED = r"""["'']([^"'']{8,})["'']"""
RULES = {
    "aws-access-token": ("AKIA[0-9A-Z]{16}", 0),
    "github-token": ("ghp_[0-9A-Za-z]{16,}", 0),
    "jwt": (r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 0),
    "private-key": ("-----BEGIN [A-Z ]*PRIVATE KEY-----", 0),
    "url-credentials": (
        r"""[a-z][a-z0-9+.-]*://[^ \t:/@]+:[^ \t/@]+@[^ \t"''<>]+""", 0,
    ),
    "assigned-secret": (rf"(?i)(?:{WORDS})[ \t]*(?:=>|=|:)[ \t]*{QUOTED}", 1),
    "hex-token": (r"\b[0-9a-f]{40}\b", 0),
}


def hits(source: str, rules: dict[str, tuple[str, int]]) -> str:
    return "\nUNION ALL ".join(
        f"""SELECT * EXCLUDE (found), generate_subscripts(found, 1) - 1 AS pos,
  unnest(found) AS value, '{name}' AS rule
FROM (SELECT * EXCLUDE (line), regexp_extract_all(line, '{pattern}', {group}) AS found
      FROM {source})"""
        for name, (pattern, group) in rules.items()
    )


def scanned(source: str, style: str, rank: int) -> str:
    return f"""
  SELECT {finding_id('repository', 'file_path', 'value')} AS id, repository, file_path,
         CAST(line_number AS INTEGER) AS line_number, rule AS secret_type, value AS secret_value,
         commit_hash, ['{style}'] AS found_by,
         row({rank}, file_path, line_number, rule, pos) AS seq
  FROM {source}"""


BITS = """-list_sum(list_transform(list_distinct(string_split({0}, '')), lambda c:
  len(list_filter(string_split({0}, ''), lambda o: o = c)) / length({0})
  * log2(len(list_filter(string_split({0}, ''), lambda o: o = c)) / length({0}))))"""
CONTEXT = (
    rf"(?i)[a-z0-9_.$-]*(?:{WORDS})[a-z0-9_]*[ \t]*(?:=>|=|:)[ \t]*["
    r""""''][^"'']{8,}["'']"""
)
SCANS = f"""{TEXTS}, {lines('texts')},
rule_hits AS ({hits('lines', RULES)}),
token_hits AS ({hits('lines', {"high-entropy": ("[A-Za-z0-9+/=_-]{20,}", 0)})}),
context_hits AS ({hits('lines', {"assignment": (CONTEXT, 0)})}),
random_hits AS (
  SELECT * FROM token_hits
  WHERE {BITS.format('value')} >= CASE
    WHEN regexp_full_match(value, '[0-9a-fA-F]+') THEN 3.0 ELSE 4.5 END),
line_hits AS (
  SELECT * EXCLUDE (line), 'keyword-line' AS rule, {strip_space('line')} AS value, 0 AS pos
  FROM lines WHERE regexp_matches(line, '(?i)(?:{WORDS})["'']?[ \\t]*(?:=|:)')),
by_rules AS ({scanned('rule_hits', 'rules', 0)}),
by_entropy AS ({scanned('random_hits', 'entropy', 1)}),
by_keywords AS ({scanned('line_hits', 'keywords', 2)}),
by_context AS ({scanned('context_hits', 'context', 3)})"""
ORACLES["text_lines"] = f"""WITH {TEXTS.split('UNION ALL')[0]}), {lines('texts')}
SELECT file_path, CAST(line_number AS INTEGER) AS line_number, line FROM lines"""
ORACLES["scan_rules"] = f"WITH {SCANS} {flat('by_rules')}"
KEYS = """keys AS (
  SELECT source AS repository, 'doc-' || doc_id AS file_path, md5(CAST(doc_id AS VARCHAR)) AS commit_hash,
         len(regexp_extract_all(text || chr(10), '\\r\\n|\\r|\\n')) AS above,
         '-----BEGIN RSA PRIVATE KEY-----' || chr(10) || md5(doc_id || 'a') || chr(10)
           || md5(doc_id || 'b') || chr(10) || '-----END RSA PRIVATE KEY-----' AS first_key,
         '-----BEGIN PRIVATE KEY-----' || chr(10) || md5(doc_id || 'c') || chr(10)
           || '-----END PRIVATE KEY-----' AS second_key
  FROM documents),
each AS (
  SELECT repository, file_path, commit_hash, above + 1 AS line_number, first_key AS secret_value
  FROM keys
  UNION ALL SELECT repository, file_path, commit_hash, above + 6, second_key FROM keys)"""
ORACLES["scan_private_keys"] = f"""WITH {KEYS}
SELECT {finding_id('repository', 'file_path', 'secret_value')} AS id, repository, file_path,
       CAST(line_number AS INTEGER) AS line_number, 'private-key' AS secret_type, secret_value,
       commit_hash, 'rules' AS found_by
FROM each"""
ORACLES["scan_entropy"] = f"""WITH {SCANS}
SELECT *, round({BITS.format('secret_value')}, 6) AS bits FROM ({flat('by_entropy')})"""
ORACLES["scan_keyword_lines"] = f"WITH {SCANS} {flat('by_keywords')}"
ORACLES["scan_with_context"] = f"WITH {SCANS} {flat('by_context')}"
ORACLES["scan_distinct_blobs"] = f"""WITH versions AS (
  SELECT source AS repository, 'file-' || (doc_id % 50) AS file_path,
         md5(doc_id || '-' || n) AS commit_hash, doc_id * 10 + n AS ts, text
  FROM documents, (VALUES (1), (2)) AS v(n)),
texts AS (
  SELECT repository, file_path, arg_min(commit_hash, row(ts, commit_hash)) AS commit_hash, text
  FROM versions GROUP BY repository, file_path, text),
{lines('texts')},
rule_hits AS ({hits('lines', RULES)}),
by_rules AS ({scanned('rule_hits', 'rules', 0)})
{flat('by_rules')}"""
ORACLES["scan_and_dedup"] = f"""WITH {SCANS},
everything AS (
  SELECT * FROM by_rules UNION ALL SELECT * FROM by_entropy
  UNION ALL SELECT * FROM by_keywords UNION ALL SELECT * FROM by_context),
found AS (SELECT *, {norm('secret_value')} AS norm FROM everything),
{passes()}
{flat('pass3')}"""
