"""The same results in DuckDB's SQL, from the driver's tables alone.

For queries on the derived corpus the SQL states what each kind of callable must give;
it never parses Python.
"""

from __future__ import annotations

from callshelf.functions.fixed_values import GENERIC_PARTS, STOP_WORDS
from callshelf.operators.nouns import ARTICLES, DIGITS, ENDING, RATIO, STRENGTH, TOKEN
from callshelf.plans.queries import DOCUMENT_BYTES, GROUP_BYTES, REPORT_K
from callshelf.sources.part_corpus import BASE, BROKEN_EVERY, FOLDERS, TEMPLATES


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _list(values: list[str]) -> str:
    return "[" + ", ".join(map(_text, values)) + "]"


def _cid(text: str) -> str:
    """CIDv1 as five-bit picks from the hex digits."""
    pick = "substring(h, (k // 4) * 5 + 1, 5)"
    bits = f"((('0x' || {pick})::int >> (15 - 5 * (k % 4))::int) & 31)"
    return (
        "(SELECT 'b' || substring(array_to_string(list_transform(range(0, 60), lambda k: "
        f"substring('abcdefghijklmnopqrstuvwxyz234567', {bits} + 1, 1)), ''), 1, 58) "
        f"FROM (SELECT '01551220' || sha256({text}) || '000' AS h))"
    )


def _filled(template: str, revision: int) -> str:
    sql = _text(template)
    values = {"k": "k", "f": "f", "doc": "doc", "size": "size", "rev": str(revision)}
    for name, column in values.items():
        sql = f"replace({sql}, '{{{name}}}', ({column})::varchar)"
    return sql


def _case(column: str, values: dict[int, str], otherwise: str | None = None) -> str:
    whens = " ".join(f"WHEN {number} THEN {value}" for number, value in values.items())
    return f"CASE {column} {whens} {'ELSE ' + otherwise if otherwise else ''} END"


_PARAMETERS = "(size: int, names: list[str], *rest: str, exact: bool, **extra: Any) -> str:"
_SHAPES = {
    0: _text(_PARAMETERS),
    1: "'(shop.Base):'",
    2: "'(session: Session) -> dict[str, Any]:'",
    3: "'(step: int, label):'",
    4: "'(size):'",
    5: "'(size):'",
    6: "'(self, size: int):'",
    7: "'(size: int):'",
    8: _text(_PARAMETERS),
    9: "'():'",
}
_NAMES = {
    0: "'part_' || k",
    1: "'Part' || k",
    2: "'fetch_shared'",
    3: "'walk_' || k",
    4: "'bare_' || k",
    5: "'blank_' || k",
    6: "'method_' || k",
    7: "'route_' || k",
    8: "'renamed_' || k",
    9: "'test_part_' || k",
}
_DOCSTRINGS = {
    0: "'Parts of file ' || f || '.' || chr(10) || chr(10) || '    ' || doc",
    2: "'Fetch what all files share.'",
    4: "NULL",
    5: "''",
    8: "'Parts of file ' || f || '.' || chr(10) || chr(10) || '    Second of its kind.'",
}
_FIRST_LINES = {0: "'Parts of file ' || f || '.'", 8: "'Parts of file ' || f || '.'"}
_FILE_TAGS = ["parts", "parts,tests", "api,billing,parts", "lib,parts,tools"]


def _corpus(revision: int = 1, prefix: str = "") -> str:
    """CTEs: ``files`` (all), ``found`` (callables of files that parse), ``valid``."""
    folder = _case("f % 4", {i: _text(name) for i, name in enumerate(FOLDERS)})
    tags = _case("f % 4", {i: _text(t) for i, t in enumerate(_FILE_TAGS)})
    source = _case("kind", {i: _filled(t, revision) for i, t in enumerate(TEMPLATES)})
    keyword = _case("kind", {1: "'class '", 2: "'async def '"}, "'def '")
    kind_name = _case("kind", {1: "'class'", 2: "'coroutine'", 3: "'generator'"}, "'function'")
    reason = _case(
        "kind",
        {4: "'no_docstring'", 5: "'no_docstring'", 6: "'not_standalone'", 7: "'not_standalone'"},
    )
    p = prefix
    return f"""{p}parts AS (
  SELECT p_partkey AS k, p_partkey // 10 AS f, p_partkey % 10 AS kind,
         p_name || ' ' || p_brand AS doc, p_size AS size
  FROM part),
{p}texts AS (
  SELECT *, '{BASE}/' || {folder} || '/parts_of_' || f || '.py' AS path, {tags} AS file_tags,
         {source} AS source_code, {_case("kind", _NAMES)} AS name,
         {_case("kind", _SHAPES)} AS shape, {keyword} AS keyword, {kind_name} AS type,
         {_case("kind", _DOCSTRINGS, "doc")} AS docstring,
         {_case("kind", _FIRST_LINES, _case("kind", _DOCSTRINGS, "doc"))} AS first_line,
         {reason} AS reject_reason
  FROM {p}parts),
{p}lines AS (
  SELECT *, length(source_code) - length(replace(source_code, chr(10), '')) + 1 AS n_lines
  FROM {p}texts),
{p}placed AS (
  SELECT *, ltrim(path, '/') AS file_path, keyword || name || shape AS signature,
         (5 + coalesce(sum(n_lines + 2) OVER (PARTITION BY f ORDER BY k
           ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::int AS line_number
  FROM {p}lines),
{p}files AS (
  SELECT f, any_value(path) AS path, (f % {BROKEN_EVERY}) = 0 AS broken,
         4 + sum(n_lines) + 2 * (count(*) - 1) + 3 AS broken_line
  FROM {p}placed GROUP BY f),
{p}found AS (SELECT * FROM {p}placed WHERE f % {BROKEN_EVERY} <> 0),
{p}valid AS (
  SELECT *, {_cid("signature || docstring || source_code")} AS code_cid,
         {_cid("shape || first_line || type || file_path")} AS cid
  FROM {p}found WHERE reject_reason IS NULL)"""


def _first_run(fits: str = "true", prefix: str = "") -> str:
    """CTEs on top of the corpus: outcomes of a run into an empty catalog, and both tables."""
    p = prefix
    return f"""{p}sized AS (SELECT *, ({fits}) AS fits FROM {p}valid),
{p}ordered AS (
  SELECT *, coalesce(max(fits) OVER (PARTITION BY cid ORDER BY path, line_number
           ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS taken
  FROM {p}sized),
{p}outcomes AS (
  SELECT *, CASE WHEN taken THEN 'duplicate' WHEN NOT fits THEN 'error' ELSE 'uploaded' END
           AS outcome
  FROM {p}ordered),
{p}uploaded AS (SELECT * FROM {p}outcomes WHERE outcome = 'uploaded'),
{p}codes AS (
  SELECT code_cid AS cid, code_cid AS version_cid, signature, docstring,
         source_code AS computer_code
  FROM (SELECT *, row_number() OVER (PARTITION BY code_cid
          ORDER BY path DESC, line_number DESC) AS back FROM {p}uploaded) WHERE back = 1),
{p}metadata AS (
  SELECT cid, code_cid, name AS code_name, type AS code_type,
         kind = 9 OR f % 4 = 1 AS is_test, file_path, file_tags AS tags
  FROM {p}uploaded)"""


_RUN = f"WITH {_corpus()}, {_first_run()}"
_FOUND = f"WITH {_corpus()}"
_FOLDERS_SEEN = "folders AS (SELECT DISTINCT split_part(path, '/', 4) AS folder FROM files)"
_FITS_150 = (
    "octet_length(encode(source_code)) <= 150 AND octet_length(encode(signature)) <= 150 "
    "AND octet_length(encode(docstring)) <= 150"
)
_STATS = """SELECT files_scanned, callables_found, skipped_not_standalone, skipped_no_docstring,
  skipped_duplicates, new_uploads,
  callables_found - skipped_not_standalone - skipped_no_docstring AS valid_callables,
  parse_errors, upload_errors, parse_errors + upload_errors AS errors
FROM (SELECT
  (SELECT count(*) FROM files) AS files_scanned,
  (SELECT count(*) FROM found) AS callables_found,
  (SELECT count(*) FROM found WHERE reject_reason = 'not_standalone') AS skipped_not_standalone,
  (SELECT count(*) FROM found WHERE reject_reason = 'no_docstring') AS skipped_no_docstring,
  (SELECT count(*) FROM outcomes WHERE outcome = 'duplicate') AS skipped_duplicates,
  (SELECT count(*) FROM outcomes WHERE outcome = 'uploaded') AS new_uploads,
  (SELECT count(*) FROM files WHERE broken) AS parse_errors,
  (SELECT count(*) FROM outcomes WHERE outcome = 'error') AS upload_errors)"""


def _summary(with_total: bool) -> str:
    from callshelf.operators.report import RULE, SUMMARY

    lines = [f"SELECT 1 AS n, '{RULE}' AS line", "SELECT 2, 'Upload Complete!'", f"SELECT 3, '{RULE}'"]
    lines += [f"SELECT {i + 4}, rpad('{label}:', 26, ' ') || {column} FROM stats"
              for i, (label, column) in enumerate(SUMMARY)]
    if with_total:
        n = len(lines) + 1
        lines += [f"SELECT {n}, ''", f"SELECT {n + 1}, 'Database now contains ' || "
                  "format('{:,}', count(DISTINCT cid)) || ' code entries' FROM codes"]
    return (f"WITH {_corpus()}, {_first_run(_FITS_150)}, stats AS ({_STATS})\n"
            + "\nUNION ALL ".join(lines))


def _status(fits: str) -> str:
    return f"""(WITH {_corpus()}, {_first_run(fits)}
SELECT CASE WHEN errors = 0 THEN 0 WHEN new_uploads > 0 THEN 1 ELSE 2 END FROM ({_STATS}))"""


_FILE_ERROR = (
    "'Syntax error in ' || path || ': invalid syntax (<unknown>, line ' || broken_line || ')'"
)

_URL_PATHS = """paths AS (
  SELECT page_id, CASE WHEN plain LIKE '%.html' THEN plain ELSE plain || '.py' END AS path
  FROM (SELECT page_id, rtrim(regexp_extract(url, '^https?://([^?#]*)', 1), '/') AS plain
        FROM pages))"""

_TAGGED = f"""{_URL_PATHS},
tagged AS (
  SELECT page_id, path, list_sort(list_distinct(list_filter(
    flatten(list_transform(
      list_filter(string_split(path, '/'), lambda p: p <> '' AND NOT regexp_matches(p, '^[.~\\\\]')
        AND NOT list_contains({_list(GENERIC_PARTS)}, lower(p))),
      lambda p: string_split_regex(regexp_replace(lower(p), '\\.py$', ''), '[-_]'))),
    lambda w: regexp_matches(w, '^\\pL') AND NOT list_contains({_list(STOP_WORDS)}, w)))) AS tags
  FROM paths)"""


def _documents(key: str, limit: int, order: str) -> str:
    """Outcomes of all documents as entries of one run."""
    return f"""ids AS (
  SELECT doc_id, source || '/' || lang AS path, {_cid(key)} AS cid, {_cid("text")} AS code_cid,
         octet_length(encode(text)) <= {limit} AS fits
  FROM documents),
firsts AS (
  SELECT *, coalesce(max(fits) OVER (PARTITION BY cid ORDER BY {order}
           ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS taken
  FROM ids),
outcomes AS (
  SELECT *, CASE WHEN taken THEN 'duplicate' WHEN NOT fits THEN 'error' ELSE 'uploaded' END
           AS outcome
  FROM firsts)"""


def _article_cases() -> str:
    return " ".join(
        f"WHEN lang = {_text(code)} THEN list_contains({_list(words)}, lower(prev))"
        for code, words in ARTICLES.items()
    )


# The noun guesser's counts and estimates; the chain of endings is unrolled.
_NOUNS = f"""toks AS (
  SELECT lang, ['.'] || regexp_extract_all(coalesce(text, ''), '{TOKEN}') AS t FROM documents),
pairs AS (
  SELECT lang, t[i] AS prev, t[i + 1] AS word
  FROM (SELECT lang, t, unnest(range(1, len(t))) AS i FROM toks)),
places AS (
  SELECT lower(word) AS word,
    CAST(coalesce(CASE {_article_cases()} ELSE false END, false)
      OR regexp_matches(prev, '^[0-9]+$')
      OR (prev NOT IN ('.', '!', '?') AND left(word, 1) <> lower(left(word, 1))) AS BIGINT) AS np
  FROM pairs WHERE regexp_matches(word, '^\\pL')),
words AS (SELECT word, count(*) AS n, CAST(sum(np) AS BIGINT) AS c FROM places GROUP BY word),
endings AS (
  SELECT right(word, k) AS ending, CAST(sum(n) AS BIGINT) AS n, CAST(sum(c) AS BIGINT) AS c
  FROM (SELECT *, unnest(range(1, least(length(word), {ENDING}) + 1)) AS k FROM words)
  GROUP BY ending),
totals AS (SELECT sum(c)::DOUBLE / sum(n) AS rate FROM words)"""


def _estimate(asked: str) -> str:
    """Estimates of the distinct words of ``asked(w)``: (w, p, noun)."""
    steps = ["rate"]
    joins = []
    for k in range(1, ENDING + 1):
        joins.append(f"LEFT JOIN endings e{k} ON length(w) >= {k} AND e{k}.ending = right(lower(w), {k})")
        prev = steps[-1]
        steps.append(
            f"CASE WHEN length(w) >= {k} THEN (coalesce(e{k}.c, 0) + {STRENGTH} * ({prev})) "
            f"/ (coalesce(e{k}.n, 0) + {STRENGTH}) ELSE ({prev}) END"
        )
    return f"""asked AS (SELECT DISTINCT w FROM {asked} WHERE w IS NOT NULL),
chained AS (
  SELECT w, rate, {steps[-1]} AS ends FROM asked CROSS JOIN totals {" ".join(joins)}),
estimated AS (
  SELECT w, (coalesce(words.c, 0) + {STRENGTH} * ends) / (coalesce(words.n, 0) + {STRENGTH}) AS p, rate
  FROM chained LEFT JOIN words ON words.word = lower(w))"""


_SECOND_RUN = f"""WITH {_corpus()}, {_first_run()}, {_corpus(2, "b_")},
stored AS (
  SELECT b.*, m.code_cid AS immutable_cid FROM b_valid b JOIN metadata m USING (cid)),
last_code AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY immutable_cid
    ORDER BY path DESC, line_number DESC) AS back FROM stored) WHERE back = 1),
last_name AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY cid
    ORDER BY path DESC, line_number DESC) AS back FROM stored) WHERE back = 1)
SELECT n.cid, n.immutable_cid AS code_cid, n.name AS code_name, n.type AS code_type,
       n.kind = 9 OR n.f % 4 = 1 AS is_test, n.file_path, n.file_tags AS tags,
       c.code_cid AS version_cid, c.signature, c.docstring, c.source_code AS computer_code
FROM last_name n JOIN last_code c USING (immutable_cid)"""

_ERROR_TEXT = "'Data too long for column ''computer_code'''"

ORACLES: dict[str, str] = {
    "q_scan_exclude": f"""WITH {_URL_PATHS},
split AS (SELECT DISTINCT path, string_split(path, '/') AS s FROM paths WHERE path LIKE '%_.py')
SELECT path FROM split
WHERE NOT s[1] LIKE '%.example.org'
  AND NOT ((s[-1] LIKE '%7.py' OR len(s) > 2 AND s[2] = 'fr') AND NOT s[-1] LIKE '%77.py')
  AND NOT (s[1] LIKE 'm.%' AND len(s) > 2 AND s[2] = 'de')""",
    "q_extract_callables": f"""{_FOUND}
SELECT path, line_number, name, type, kind = 2 AS is_async, source_code FROM found""",
    "q_scan_tree": f"""{_FOUND}, {_FOLDERS_SEEN}
SELECT substring(path, {len(BASE) + 2}) AS path, line_number, name, false AS failed FROM found
UNION ALL SELECT substring(path, {len(BASE) + 2}), NULL, NULL, broken FROM files
UNION ALL SELECT folder || '/__init__.py', NULL, NULL, false FROM folders
UNION ALL SELECT 'latin.py', NULL, NULL, true""",
    "q_type_counts": f"{_FOUND} SELECT type, count(*) AS n FROM found GROUP BY type",
    "q_signatures": f"{_FOUND} SELECT path, name, signature FROM found",
    "q_docstrings": f"{_FOUND} SELECT path, name, docstring FROM found",
    "q_decorators": f"""{_FOUND}
SELECT path, name, 0 AS position, 'staticmethod' AS decorator FROM found WHERE kind = 7
UNION ALL
SELECT path, name, 1, 'shop.route(''/part/' || k || ''', methods=[''GET'', ''POST''])'
FROM found WHERE kind = 7""",
    "q_parse_errors": f"{_FOUND} SELECT path, {_FILE_ERROR} AS error FROM files WHERE broken",
    "q_extract_documents": """SELECT
  '/srv/notes/' || source || '/note_' || doc_id || '.py' AS path, 'note_' || doc_id AS name,
  'function' AS type, 'def note_' || doc_id || '(lang: str) -> str:' AS signature,
  trim(regexp_replace(text || chr(10), '[ \\t]+\\n', chr(10), 'g'), chr(10)) AS docstring,
  (length(text) + length(text) - length(replace(text, '"', ''))
    + length('def note_' || doc_id || '(lang: str = "' || lang || '") -> str:')
    + 1 + 4 + 6 + 1 + length('    return lang'))::int AS source_chars
FROM documents""",
    "q_validate": f"{_FOUND} SELECT path, name, reject_reason FROM found",
    "q_valid": f"""{_FOUND}
SELECT path, line_number, name, type FROM found WHERE reject_reason IS NULL""",
    "q_content_cid": f"SELECT doc_id, {_cid('text')} AS cid FROM documents",
    "q_code_cid": f"{_FOUND} SELECT path, name, code_cid FROM valid",
    "q_interface_cid": f"{_FOUND} SELECT file_path, name, cid FROM valid",
    "q_is_test": f"{_FOUND} SELECT path, name, kind = 9 OR f % 4 = 1 AS is_test FROM found",
    "q_path_tags": f"""WITH {_TAGGED}
SELECT page_id, path, array_to_string(tags, ',') AS tags FROM tagged""",
    "q_tag_counts": f"""WITH {_TAGGED}
SELECT tag, count(*) AS n FROM (SELECT unnest(tags) AS tag FROM tagged) GROUP BY tag""",
    "q_tags_json": f"""WITH {_TAGGED}
SELECT page_id, '[' || array_to_string(list_transform(tags, lambda t: '"' || t || '"'), ',') || ']'
  AS tags_json FROM tagged""",
    "q_tags_json_text": r"""SELECT doc_id, '[' || array_to_string(list_transform(
  regexp_extract_all(text, '[^\x20\x09-\x0D]+'),
  lambda w: '"' || array_to_string(list_transform(regexp_extract_all(w, '(?s).'), lambda c:
    CASE WHEN c = '"' THEN '\"' WHEN c = '\' THEN '\\' WHEN c = chr(10) THEN '\n'
      WHEN c = chr(13) THEN '\r' WHEN c = chr(9) THEN '\t' WHEN c = chr(8) THEN '\b'
      WHEN c = chr(12) THEN '\f'
      WHEN unicode(c) >= 65536 THEN
        printf('\u%04x\u%04x', 55296 + ((unicode(c) - 65536) >> 10),
               56320 + ((unicode(c) - 65536) & 1023))
      WHEN unicode(c) < 32 OR unicode(c) > 126 THEN printf('\u%04x', unicode(c))
      ELSE c END), '') || '"'), ', ') || ']' AS tags_json
FROM documents""",
    "q_word_list_tags": f"""WITH {_TAGGED},
words AS (SELECT list(DISTINCT lang) AS w FROM documents)
SELECT page_id, array_to_string(list_filter(tags, lambda t: NOT list_contains(w, t)), ',') AS tags
FROM tagged, words""",
    "q_dedup_first_wins": f"""WITH {_documents("text", DOCUMENT_BYTES, "path, doc_id")}
SELECT doc_id, outcome, CASE WHEN outcome = 'uploaded' THEN code_cid END AS immutable_cid
FROM outcomes""",
    "q_hot_groups": f"""WITH {_documents("lang", GROUP_BYTES, "doc_id")}
SELECT doc_id, outcome, CASE WHEN outcome = 'uploaded' THEN code_cid END AS immutable_cid
FROM outcomes""",
    "q_exists_known": f"""SELECT doc_id, {_cid('text')} AS cid FROM documents
WHERE text IN (SELECT text FROM documents JOIN labels USING (doc_id))""",
    "q_exists_new": f"""SELECT doc_id, {_cid('text')} AS cid FROM documents
WHERE text NOT IN (SELECT text FROM documents JOIN labels USING (doc_id))""",
    "q_outcomes_known": f"""WITH {_documents("text", DOCUMENT_BYTES, "path, doc_id")},
labelled AS (SELECT DISTINCT code_cid FROM ids JOIN labels USING (doc_id)),
decided AS (
  SELECT path, CASE WHEN code_cid IN (SELECT code_cid FROM labelled) THEN 'duplicate'
                    ELSE outcome END AS outcome
  FROM outcomes)
SELECT path, outcome, count(*) AS n FROM decided GROUP BY path, outcome""",
    "q_upsert_codes": f"{_RUN} SELECT * FROM codes",
    "q_upsert_metadata": f"{_RUN} SELECT * FROM metadata",
    "q_bypass_upsert": _SECOND_RUN,
    "q_catalog_join": f"""{_RUN}
SELECT file_path, code_name, code_type, signature, docstring, version_cid
FROM metadata m JOIN codes c ON m.code_cid = c.cid""",
    "q_store_total": f"""{_RUN}
SELECT count(*) AS total, format('{{:,}}', count(*)) AS shown FROM codes""",
    "q_word_list_catalog": f"""{_RUN}
SELECT cid, file_path, code_name, coalesce(array_to_string(
  [t for t in string_split(tags, ',') if t NOT IN ('tools', 'parts')], ','), '') AS tags
FROM metadata""",
    "q_dry_run": f"""WITH {_corpus(2)}
SELECT path, line_number, name, substring(code_cid, 1, 12) AS short_cid,
       split_part(path, '/', 4) IN ({', '.join(map(_text, FOLDERS[:2]))}) AS known
FROM valid""",
    "q_incremental": f"""{_RUN}
SELECT m.*, c.version_cid, c.signature, c.docstring, c.computer_code
FROM metadata m JOIN codes c ON m.code_cid = c.cid""",
    # the same catalog as one run: interface ids hold the path, parts share no file
    "q_tree_stream": f"""{_RUN}
SELECT m.*, c.version_cid, c.signature, c.docstring, c.computer_code
FROM metadata m JOIN codes c ON m.code_cid = c.cid""",
    "q_upload_errors": f"""WITH {_documents("text", DOCUMENT_BYTES, "path, doc_id")}
SELECT path, doc_id AS line_number, 'doc_' || doc_id AS name, {_ERROR_TEXT} AS error
FROM outcomes WHERE outcome = 'error'""",
    "q_top_errors": f"""WITH {_corpus()}, {_documents("text", DOCUMENT_BYTES, "path, doc_id")},
failures AS (
  SELECT 'parse' AS kind, path, NULL::bigint AS line_number, NULL AS name, {_FILE_ERROR} AS error
  FROM files WHERE broken
  UNION ALL
  SELECT 'upload', path, doc_id, 'doc_' || doc_id, {_ERROR_TEXT}
  FROM outcomes WHERE outcome = 'error'),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY kind ORDER BY path, line_number) AS rank,
         count(*) OVER (PARTITION BY kind) AS total FROM failures)
SELECT kind, rank::int AS rank, path AS file, name AS callable, error,
       greatest(total - {REPORT_K}, 0) AS more
FROM ranked WHERE rank <= {REPORT_K}""",
    "q_run_stats": f"WITH {_corpus()}, {_first_run(_FITS_150)} {_STATS}",
    "q_summary": _summary(True),
    "q_summary_without_total": _summary(False),
    "q_noun_estimates": f"""WITH {_NOUNS}, word_list AS (SELECT word AS w FROM words), {_estimate("word_list")}
SELECT word, n, c, round(p, {DIGITS}) AS p, coalesce(p >= rate * {RATIO}, false) AS noun
FROM words JOIN estimated ON w = word""",
    "q_noun_tags": f"""WITH {_TAGGED}, {_NOUNS},
tag_words AS (SELECT DISTINCT unnest(tags) AS w FROM tagged), {_estimate("tag_words")},
kept AS (SELECT coalesce(list(w), []) AS nl FROM estimated WHERE coalesce(p >= rate * {RATIO}, false))
SELECT page_id, array_to_string(list_filter(tags, lambda t: list_contains(nl, t)), ',') AS tags
FROM tagged, kept""",
    "q_run_status": f"""SELECT 'some' AS run, {_status(_FITS_150)} AS status
UNION ALL SELECT 'none', {_status('false')}""",
}
