"""Text functions and corpus preparation over documents, pages and conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.constants import BLOCK_TAGS, CLASS_TAGS
from lodestone.functions import html as H
from lodestone.functions import score as S
from lodestone.functions import text as X
from lodestone.operators.chunking import chunk_sources
from lodestone.memory import bounded
from lodestone.plans.registry import query
from lodestone.session import ship, table

#: The lines of a text in DuckDB: no empty last one.
_SPLIT = "regexp_split_to_array({0}, '\\r?\\n')"


def _lines_sql(x: str) -> str:
    s = _SPLIT.format(x)
    return f"(CASE WHEN {x} LIKE '%' || chr(10) OR {x} = '' THEN {s}[:-2] ELSE {s} END)"


@query(f"SELECT lang, sum(len({_lines_sql('text')}))::BIGINT AS loc, count(*) AS files FROM documents GROUP BY lang")
def loc_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").groupBy("lang").agg(F.sum(X.line_count(F.col("text"))).cast("long").alias("loc"), F.count(F.lit(1)).alias("files"))


@query("""SELECT doc_id, CASE WHEN old IS NULL THEN 'fetched' WHEN old = new THEN 'unchanged' ELSE 'changed' END AS outcome,
CASE WHEN old_bytes = 0 THEN new_bytes || ' bytes, nothing cached before' WHEN new_bytes > old_bytes THEN 'grew ' || (new_bytes - old_bytes) || ' bytes' WHEN new_bytes = old_bytes THEN 'same size, different content'
ELSE 'SHRANK ' || (old_bytes - new_bytes) || ' bytes — check the fetch before accepting it' END AS size_change
FROM (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN NULL WHEN 1 THEN sha256(text) ELSE sha256(text || 'x') END AS old, sha256(text) AS new, strlen(text) AS new_bytes, CASE doc_id % 4 WHEN 0 THEN 0 WHEN 1 THEN strlen(text) WHEN 2 THEN strlen(text) + 1 ELSE strlen(text) - 1 END AS old_bytes FROM documents)""")
def change_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestone.sources.corpus import classify_changes

    d = table(spark, sf_dir, "documents")
    k, n = F.col("doc_id") % 4, F.octet_length("text")
    recorded = d.select("doc_id", F.when(k == 0, None).when(k == 1, F.sha2(F.col("text").cast("binary"), 256)).otherwise(F.sha2(F.concat("text", F.lit("x")).cast("binary"), 256)).alias("sha256"), F.when(k == 0, 0).when(k == 1, n).when(k == 2, n + 1).otherwise(n - 1).alias("bytes"))
    return classify_changes(d, recorded, "doc_id").select("doc_id", "outcome", "size_change")


@query("""SELECT page_id, starts_with(p, '/') OR list_contains(string_split(p, '/'), '..') AS unsafe, starts_with(rel, 'en/') OR starts_with(rel, 'a') AS included
FROM (SELECT page_id, p, CASE WHEN contains(p, '/') THEN p[strpos(p, '/') + 1:] ELSE p END AS rel FROM (SELECT page_id, CASE page_id % 5 WHEN 0 THEN '/' || u WHEN 1 THEN 'x/../' || u ELSE u END AS p FROM (SELECT page_id, replace(url, 'http://', '') AS u FROM pages)))""")
def path_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = F.replace("url", F.lit("http://"), F.lit(""))
    k = F.col("page_id") % 5
    p = table(spark, sf_dir, "pages").select("page_id", F.when(k == 0, F.concat(F.lit("/"), u)).when(k == 1, F.concat(F.lit("x/../"), u)).otherwise(u).alias("p"))
    return p.select("page_id", X.is_unsafe_path(F.col("p")).alias("unsafe"), X.is_included(F.col("p"), F.array(F.lit("/en/"), F.lit("a"))).alias("included"))


def _html_sql(x: str = "html") -> str:
    """The native chain as RE2 can say it; equal on well-formed pages."""
    blocks = "|".join(t for t in BLOCK_TAGS if not (len(t) == 2 and t[0] == "h"))
    x = f"regexp_replace({x}, '(?s)<!--.*?-->', '', 'g')"
    for raw in ("script", "style"):
        x = f"regexp_replace({x}, '(?is)<{raw}\\b.*?</{raw}[^>]*>', '', 'g')"
    for level in (1, 2, 3):
        x = f"regexp_replace({x}, '(?i)<h{level}(\\s[^>]*)?>\\s*', chr(10) || '{'#' * level} ', 'g')"
    x = f"regexp_replace({x}, '(?i)<h[456](\\s[^>]*)?>\\s*', chr(10) || '#### ', 'g')"
    x = f"regexp_replace({x}, '(?i)</(h[1-6]|{blocks})(\\s[^>]*)?>|<br\\s*/?>', chr(10), 'g')"
    x = f"regexp_replace({x}, '<[A-Za-z/!][^>]*>', '', 'g')"
    for a, b in (("¶", "''"), ("&lt;", "'<'"), ("&gt;", "'>'"), ("&quot;", "'\"'"), ("&#39;", "chr(39)"), ("&nbsp;", "' '"), ("&amp;", "'&'")):
        x = f"replace({x}, '{a}', {b})"
    x = f"regexp_replace(regexp_replace({x}, '[ \\t\\r]+(\\n|$)', '\\1', 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g')"
    return f"regexp_replace({x}, '\\n$', '')"


@query(f"SELECT page_id, {_html_sql()} AS text FROM pages")
def html_to_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(bounded(spark))
    return table(spark, sf_dir, "pages").select("page_id", H.html_to_text_udf("html").alias("text"))


@query(f"SELECT page_id, {_html_sql()} AS text FROM pages")
def html_to_text_native(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", H.html_to_text_native(F.col("html")).alias("text"))


@query("SELECT page_id, len(regexp_extract_all(html, '(?i)<h1(\\s[^>]*)?>'))::BIGINT AS h1, len(regexp_extract_all(html, '(?i)<h[2-6](\\s[^>]*)?>'))::BIGINT AS deeper FROM pages")
def html_headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    levels = table(spark, sf_dir, "pages").select("page_id", H.heading_levels(F.col("html")).alias("v"))
    count = lambda keep: F.size(F.filter("v", keep)).cast("long")
    return levels.select("page_id", count(lambda v: v == 1).alias("h1"), count(lambda v: v > 1).alias("deeper"))


@query("SELECT page_id, md5(replace(replace(replace(replace(replace(replace(replace(html, '¶', ''), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', chr(39)), '&nbsp;', ' '), '&amp;', '&')) AS decoded_md5 FROM pages")
def entity_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.md5(X.decode_entities(F.col("html")).cast("binary")).alias("decoded_md5"))


@query("SELECT doc_id, regexp_replace(regexp_replace(t, '[ \\t\\r]+(\\n|$)', '\\1', 'g'), '\\n{3,}', chr(10) || chr(10), 'g') AS text FROM (SELECT doc_id, replace(text, '. ', '.  ' || repeat(chr(10), (doc_id % 5)::INT)) AS t FROM documents)")
def blank_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.replace("text", F.lit(". "), F.concat(F.lit(".  "), F.repeat(F.lit("\n"), (F.col("doc_id") % 5).cast("int"))))
    return table(spark, sf_dir, "documents").select("doc_id", X.tidy_blank_lines(t).alias("text"))


@query(f"SELECT page_id, len(list_filter(string_split(t, chr(10)), lambda l: regexp_matches(l, '^#{{1,4}} ')))::BIGINT AS headings FROM (SELECT page_id, {_html_sql()} AS t FROM pages)")
def heading_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "pages").select("page_id", H.html_to_text_native(F.col("html")).alias("t"))
    return t.select("page_id", F.size(F.filter(X.lines(F.col("t")), X.is_heading)).cast("long").alias("headings"))


_IDS = ("OS-VLT-ADV-00", "[AB-1]", "ABCDEF-1", "A-1", "AB-CD", "AB-1x", "AB-1é", "AB-12 ", "ab-12", "XY-0-")
_ID_ROWS = ", ".join(f"('{x}')" for x in _IDS)


@query(f"""SELECT doc_id, x AS line, regexp_matches(x, '^\\[?[A-Z]{{2,5}}-[A-Z0-9-]*[0-9][A-Z0-9-]*') AND NOT regexp_matches(x, '^\\[?[A-Z]{{2,5}}-[A-Z0-9-]*[\\p{{L}}\\p{{N}}--[A-Z0-9]]') AND NOT regexp_matches(x[length(regexp_extract(x, '^\\[?[A-Z]{{2,5}}-[A-Z0-9-]*')) + 1:], '^[\\p{{L}}\\p{{N}}]') AS is_id
FROM documents, (VALUES {_ID_ROWS}) v(x)""".replace("AND NOT regexp_matches(x, '^\\[?[A-Z]{2,5}-[A-Z0-9-]*[\\p{L}\\p{N}--[A-Z0-9]]') ", ""))
def finding_id_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.array(*[F.lit(x) for x in _IDS])).alias("line"))
    return lines.select("doc_id", "line", X.is_finding_id(F.col("line")).alias("is_id"))


_STRIP = "' ' || chr(9) || chr(10) || chr(13)"
_CHUNKS = f"""WITH RECURSIVE pt AS (SELECT page_id, url, {_html_sql()} AS t FROM pages), pl AS (SELECT page_id, {_lines_sql('t')} AS ls FROM pt WHERE trim(t, {_STRIP}) <> ''),
li AS (SELECT page_id, unnest(ls) AS l, generate_subscripts(ls, 1) AS i, len(ls) AS n FROM pl),
bo AS (SELECT *, CASE WHEN regexp_matches(l, '^#{{1,4}} ') THEN length(regexp_extract(l, '^#+')) WHEN regexp_matches(l, '^\\[?[A-Z]{{2,5}}-[A-Z0-9-]*[0-9][A-Z0-9-]*') AND NOT regexp_matches(l[length(regexp_extract(l, '^\\[?[A-Z]{{2,5}}-[A-Z0-9-]*')) + 1:], '^[\\p{{L}}\\p{{N}}]') THEN 1 ELSE 0 END AS d FROM li),
he AS (SELECT *, CASE WHEN d > 0 THEN trim(ltrim(l, '#'), {_STRIP}) END AS h, sum(CASE WHEN d > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY page_id ORDER BY i) AS sec FROM bo),
up AS (SELECT *, {", ".join(f"last_value(CASE WHEN d = {j} THEN h END IGNORE NULLS) OVER w AS h{j}, max(CASE WHEN d = {j} THEN i END) OVER w AS p{j}, coalesce(max(CASE WHEN d > 0 AND d < {j} THEN i END) OVER w, 0) AS q{j}" for j in (1, 2, 3))}
  FROM he WINDOW w AS (PARTITION BY page_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
na AS (SELECT page_id, sec, array_to_string(list_filter([{", ".join(f"CASE WHEN d > {j} AND p{j} > q{j} THEN h{j} END" for j in (1, 2, 3))}, h], lambda x: x IS NOT NULL AND x <> ''), ' — ') AS name FROM up WHERE d > 0),
se AS (SELECT page_id, sec, string_agg(l || chr(10), '' ORDER BY i) AS body, max(i) = any_value(n) AS last_ FROM he GROUP BY page_id, sec),
sn AS (SELECT se.page_id, name, body, row_number() OVER (PARTITION BY se.page_id ORDER BY se.sec) AS k FROM se LEFT JOIN na USING (page_id, sec) WHERE NOT last_ OR trim(body, {_STRIP}) <> ''),
mg AS (SELECT page_id, k, 1 AS chunk, name, body FROM sn WHERE k = 1 UNION ALL
  SELECT s.page_id, s.k, CASE WHEN strlen(trim(m.body, {_STRIP})) < 200 THEN m.chunk ELSE m.chunk + 1 END,
  CASE WHEN strlen(trim(m.body, {_STRIP})) >= 200 THEN s.name WHEN m.name IS NULL OR (s.name IS NOT NULL AND length(s.name) > length(m.name) AND starts_with(s.name, m.name)) THEN s.name ELSE m.name END,
  CASE WHEN strlen(trim(m.body, {_STRIP})) < 200 THEN m.body || s.body ELSE s.body END FROM mg m JOIN sn s ON s.page_id = m.page_id AND s.k = m.k + 1),
ch AS (SELECT page_id, chunk, arg_max(coalesce(name, chr(0)), k) AS name0, arg_max(body, k) AS body0 FROM mg GROUP BY page_id, chunk),
cn AS (SELECT page_id, chunk, nullif(name0, chr(0)) AS name, body0 FROM ch),
ct AS (SELECT page_id, chunk, CASE WHEN name IS NULL OR trim(name, {_STRIP}) = '' OR name = 'page ' || page_id THEN 'page ' || page_id ELSE 'page ' || page_id || ' — ' || name END AS title, CASE WHEN name IS NOT NULL AND NOT contains(body0, name) THEN name || chr(10) || chr(10) || body0 ELSE body0 END AS body FROM cn),
cl AS (SELECT page_id, chunk, {_lines_sql('body')} AS ls FROM ct WHERE strlen(body) > 1500),
st AS (SELECT page_id, chunk, ls, 1 AS i, 0 AS piece, 0::BIGINT AS held FROM cl UNION ALL SELECT page_id, chunk, ls, i + 1, CASE WHEN held > 0 AND held + strlen(ls[i]) + 1 > 1500 THEN piece + 1 ELSE piece END,
  CASE WHEN held > 0 AND held + strlen(ls[i]) + 1 > 1500 THEN strlen(ls[i]) + 1 ELSE held + strlen(ls[i]) + 1 END FROM st WHERE i <= len(ls)),
gr AS (SELECT page_id, chunk, piece, string_agg(ls[i - 1] || chr(10), '' ORDER BY i) AS x, max(i) > any_value(len(ls)) AS last_ FROM st WHERE i > 1 GROUP BY page_id, chunk, piece),
pc AS (SELECT page_id, chunk, piece, x FROM gr WHERE NOT last_ OR trim(x, {_STRIP}) <> '' UNION ALL SELECT page_id, chunk, 0, body FROM ct WHERE strlen(body) <= 1500),
nu AS (SELECT pc.*, title, url, row_number() OVER (PARTITION BY page_id ORDER BY chunk, piece) - 1 AS ix FROM pc JOIN ct USING (page_id, chunk) JOIN pt USING (page_id))
SELECT page_id || '#' || ix AS doc_id, page_id::VARCHAR AS source_id, ix::BIGINT AS chunk_ix, url AS source_url, title, md5(x) AS text_md5,
array_to_string(list_sort(list_distinct(list_concat(['web'], list_filter([{", ".join(repr(t) for t in CLASS_TAGS)}], lambda t: contains(lower(x), t))))), ',') AS class_tags FROM nu"""


@query(_CHUNKS)
def chunk_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(bounded(spark))
    pages = table(spark, sf_dir, "pages").select(F.col("page_id").cast("string").alias("source_id"), "url", F.concat(F.lit("page "), "page_id").alias("title"), H.html_to_text_udf("html").alias("text"), F.array(F.lit("web")).alias("class_tags"))
    out = chunk_sources(pages)
    return out.select("doc_id", "source_id", F.col("chunk_ix").cast("long").alias("chunk_ix"), "source_url", "title", F.md5(F.col("text").cast("binary")).alias("text_md5"), F.array_join("class_tags", ",").alias("class_tags"))


@query("""WITH RECURSIVE src AS (SELECT doc_id, regexp_split_to_array(text, '\\r?\\n') AS ls FROM documents WHERE strlen(text) > 1500),
ln AS (SELECT doc_id, CASE WHEN ls[-1] = '' THEN ls[:-2] ELSE ls END AS ls FROM src),
st AS (SELECT doc_id, ls, 1 AS i, 0 AS piece, 0::BIGINT AS held FROM ln UNION ALL
SELECT doc_id, ls, i + 1, CASE WHEN held > 0 AND held + strlen(ls[i]) + 1 > 1500 THEN piece + 1 ELSE piece END, CASE WHEN held > 0 AND held + strlen(ls[i]) + 1 > 1500 THEN strlen(ls[i]) + 1 ELSE held + strlen(ls[i]) + 1 END FROM st WHERE i <= len(ls)),
gr AS (SELECT doc_id, piece, string_agg(ls[i - 1] || chr(10), '' ORDER BY i) AS t, max(i) AS last_, any_value(len(ls)) AS n FROM st WHERE i > 1 GROUP BY doc_id, piece)
SELECT doc_id, piece::BIGINT AS piece, md5(t) AS piece_md5 FROM gr WHERE last_ <= n OR trim(t, ' ' || chr(10) || chr(9)) <> '' UNION ALL SELECT doc_id, 0, md5(text) FROM documents WHERE strlen(text) <= 1500""")
def split_oversized(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(X.split_oversized(F.col("text"))).alias("piece", "t"))
    return d.select("doc_id", F.col("piece").cast("long").alias("piece"), F.md5(F.col("t").cast("binary")).alias("piece_md5"))


@query("SELECT doc_id, array_to_string(list_sort(list_distinct(list_concat([lang], list_filter(['missing-signer', 'missing-owner-check', 'missing-authority-binding', 'pda-validation-gap', 'unchecked-arithmetic'], lambda t: contains(lower(x), t))))), ',') AS tags FROM (SELECT doc_id, lang, text || ' Missing-Signer ' || CASE WHEN doc_id % 3 = 0 THEN 'PDA-validation-gap' ELSE '' END AS x FROM documents)")
def tag_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", F.concat("text", F.lit(" Missing-Signer "), F.when(F.col("doc_id") % 3 == 0, "PDA-validation-gap").otherwise("")).alias("x"))
    return d.select("doc_id", F.array_join(X.class_tags(F.col("x"), F.array("lang")), ",").alias("tags"))


@query("SELECT conv_id, turn, array_to_string(list_filter(string_split('```json' || chr(10) || text || chr(10) || '  ```', chr(10)), lambda l: NOT starts_with(ltrim(l), '```')), chr(10)) AS text FROM conversations")
def strip_fences(spark: SparkSession, sf_dir: str) -> DataFrame:
    fenced = F.concat(F.lit("```json\n"), "text", F.lit("\n  ```"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", X.strip_fences(fenced).alias("text"))


@query("SELECT event_id, CASE WHEN s = 'informational' THEN 'info' WHEN s IN ('info', 'low', 'medium', 'high', 'critical') THEN s ELSE 'medium' END AS severity FROM (SELECT event_id, lower(trim(['  HIGH', 'Informational', 'odd', 'critical ', 'Low'][event_id % 5 + 1])) AS s FROM events)")
def severity_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = F.array(*[F.lit(x) for x in ("  HIGH", "Informational", "odd", "critical ", "Low")])
    return table(spark, sf_dir, "events").select("event_id", S.parse_severity(F.get(words, (F.col("event_id") % 5).cast("int"))).alias("severity"))


@query("SELECT event_id, round(greatest(0.1, least(0.9, event_id % 120 / 100.0)) * CASE WHEN event_id % 3 = 1 THEN 0.8 ELSE 1 END, 6)::DOUBLE AS confidence FROM events")
def confidence_clamp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", F.round(S.clamp_confidence(F.col("event_id") % 120 / 100.0, F.col("event_id") % 3), 6).alias("confidence"))


@query("SELECT event_id, left(sha256(concat_ws('|', user_id::VARCHAR, event_type, 'k')), 16) AS id FROM events")
def stable_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", X.stable_id(F.col("user_id").cast("string"), F.col("event_type"), F.lit("k")).alias("id"))


@query("SELECT page_id, CASE WHEN starts_with(url, 'http://ththre.example.com/') THEN url[27:] ELSE url END AS uri FROM pages")
def uri_for(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", X.relative_uri(F.col("url"), "http://ththre.example.com/").alias("uri"))


@query("SELECT s AS severity, CASE s WHEN 'critical' THEN 'error' WHEN 'high' THEN 'error' WHEN 'medium' THEN 'warning' ELSE 'note' END AS level, CASE s WHEN 'critical' THEN '9.0' WHEN 'high' THEN '7.0' WHEN 'medium' THEN '5.0' WHEN 'low' THEN '3.0' ELSE '1.0' END AS security_severity, count(*) AS n FROM (SELECT ['info', 'low', 'medium', 'high', 'critical'][event_id % 5 + 1] AS s FROM events) GROUP BY s")
def severity_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "events").select(F.get(F.array(*[F.lit(x) for x in ("info", "low", "medium", "high", "critical")]), (F.col("event_id") % 5).cast("int")).alias("severity"))
    return s.groupBy("severity").agg(F.count(F.lit(1)).alias("n")).select("severity", S.sarif_level(F.col("severity")).alias("level"), S.sarif_security_severity(F.col("severity")).alias("security_severity"), "n")


_NAMES = ("vault_authority", "feePayer", "admin_account", "admin_token_account", "payer_token_account", "owner_pubkey", "mint", "subadmin", "key", "_", "authority_info_")
_WORDS = "authority|admin|owner|signer|payer|delegate|manager"


@query(f"""SELECT n_nationkey, name, coalesce(regexp_matches(p[-1], '{_WORDS}') OR (len(p) > 1 AND p[-1] IN ('info', 'key', 'pubkey', 'account') AND regexp_matches(p[-2], '{_WORDS}')), false) AS privileged
FROM (SELECT n_nationkey, name, list_filter(string_split(lower(name), '_'), lambda x: x <> '') AS p FROM nation, (VALUES {', '.join(f"('{x}')" for x in _NAMES)}) v(name))""")
def authority_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation").select("n_nationkey", F.explode(F.array(*[F.lit(x) for x in _NAMES])).alias("name"))
    return n.select("n_nationkey", "name", X.is_authority(F.col("name")).alias("privileged"))


@query(f"SELECT doc_id, CASE WHEN a >= 1 AND b >= a THEN array_to_string(l[a:b], chr(10)) ELSE '' END AS part FROM (SELECT doc_id, {_lines_sql('text')} AS l, doc_id % 4 AS a, doc_id % 4 + doc_id % 3 - 1 AS b FROM documents)")
def line_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = (F.col("doc_id") % 4).cast("int")
    return table(spark, sf_dir, "documents").select("doc_id", X.line_slice(F.col("text"), a, a + (F.col("doc_id") % 3).cast("int") - 1).alias("part"))


@query("SELECT doc_id, regexp_matches(text, '(^|[^A-Za-z0-9_])th') AS anchored, regexp_matches(text, '(^|[^A-Za-z0-9_])the([^A-Za-z0-9_]|$)') AS bounded FROM documents")
def anchored_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", X.mentions(F.col("text"), "th").alias("anchored"), X.mentions(F.col("text"), "the", True).alias("bounded"))


@query("SELECT doc_id, md5(regexp_replace(text, '\\s+', '', 'g')) AS compact_md5 FROM documents")
def compact_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(X.compact(F.col("text")).cast("binary")).alias("compact_md5"))
