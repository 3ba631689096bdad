"""Scalar functions, answer cleaning and identity over tables with injected markup."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import functions as fn
from ..functions import answers, init_data
from ..operators import latest_child
from ..sources import arrow_batches, dealt, json_body, json_response, literal, media_messages, spread, table, valid_text

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def docs(spark, d):
    return table(spark, d, "documents").select("doc_id", "text")


@query("f1_prefixes", "SELECT doc_id, substring(text, 1, 120) AS p120, substring(text, 1, 80) AS p80 FROM documents")
def f1(spark, d):
    return docs(spark, d).select("doc_id", fn.prefix(F.col("text"), 120).alias("p120"), fn.prefix(F.col("text"), 80).alias("p80"))


@query("f2_display_name", """
SELECT c_custkey, coalesce(nullif(trim(concat(CASE WHEN c_custkey % 3 = 0 THEN '' WHEN c_custkey % 3 = 1 THEN 'Ann' END, ' ', CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment ELSE '' END)), ''), 'User ' || c_custkey) AS display_name FROM customer
""")
def f2(spark, d):
    first = F.when(F.col("c_custkey") % 3 == 0, "").when(F.col("c_custkey") % 3 == 1, "Ann")
    last = F.when(F.col("c_custkey") % 2 == 0, F.col("c_mktsegment"))
    return table(spark, d, "customer").select("c_custkey", fn.display_name(first, last, F.col("c_custkey")).alias("display_name"))


@query("f3_defaults", "SELECT c_custkey, CASE WHEN c_custkey % 4 < 2 THEN 'user_' || c_custkey ELSE c_name END AS username, CASE WHEN c_custkey % 3 = 0 THEN 'en' ELSE 'ru' END AS lang FROM customer")
def f3(spark, d):
    k = F.col("c_custkey")
    name = F.when(k % 4 == 0, F.lit("")).when(k % 4 > 1, F.col("c_name"))
    lang = F.when(k % 3 == 0, "en").when(k % 3 == 1, "")
    return table(spark, d, "customer").select("c_custkey", fn.first_nonempty(name, F.concat(F.lit("user_"), k.cast("string"))).alias("username"), fn.first_nonempty(lang, F.lit("ru")).alias("lang"))


@query("f4_remaining", "SELECT p_partkey, CAST(greatest(0, 20 - CASE WHEN p_size % 5 = 0 THEN 0 ELSE p_size END) AS BIGINT) AS remaining FROM part")
def f4(spark, d):
    used = F.when(F.col("p_size") % 5 != 0, F.col("p_size"))
    return table(spark, d, "part").select("p_partkey", fn.remaining(F.lit(20), used).cast("bigint").alias("remaining"))


@query("f5_int_or_null", """
SELECT c_custkey, CASE c_custkey % 8 WHEN 0 THEN c_custkey WHEN 1 THEN -c_custkey WHEN 2 THEN c_custkey END AS n FROM customer
""")
def f5(spark, d):
    k = F.col("c_custkey")
    name = k.cast("string")
    forms = [F.concat(F.lit(" "), name, F.lit(" ")), F.concat(F.lit("-"), name), F.concat(F.lit("\u3000+"), name), F.concat(F.lit("1_"), name), F.concat(name, F.lit("x")), F.lit(""), F.lit(None).cast("string"), F.concat(F.lit("9" * 20), name)]
    written = F.element_at(F.array(*forms), (k % 8 + 1).cast("int"))
    return table(spark, d, "customer").select("c_custkey", fn.int_or_null(written).alias("n"))


@query("f12_id_set", "SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN '' WHEN c_custkey % 3 = 1 THEN CAST(c_custkey AS VARCHAR) ELSE c_custkey || ',' || (c_custkey + 1) END AS ids FROM customer")
def f12(spark, d):
    k = F.col("c_custkey")
    one, two = k.cast("string"), (k + 1).cast("string")
    written = F.when(k % 3 == 0, "x, ,1_0").when(k % 3 == 1, F.concat(one, F.lit(" , "), one)).otherwise(F.concat(F.lit(" "), two, F.lit(", x,,"), one, F.lit(", "), two))
    return table(spark, d, "customer").select("c_custkey", F.array_join(F.array_sort(fn.id_set(written)).cast("array<string>"), ",").alias("ids"))


F13_SQL = "SELECT page_id, 'data:text/html;base64,' || to_base64(encode(html)) AS url FROM pages"


@query("f13_data_url", F13_SQL)
def f13(spark, d):
    return table(spark, d, "pages").select("page_id", fn.data_url(F.lit("text/html"), F.encode("html", "UTF-8")).alias("url"))


@query("f15_append_query", "SELECT page_id, url || CASE WHEN contains(url, '?') THEN '&' ELSE '?' END || 'uid=5' AS url FROM pages")
def f15(spark, d):
    return table(spark, d, "pages").select("page_id", fn.append_query(F.col("url"), F.lit("uid=5")).alias("url"))


@query("f16_coalesce", "SELECT doc_id, coalesce(nullif(lang, 'en'), source) AS v FROM documents")
def f16(spark, d):
    return table(spark, d, "documents").select("doc_id", F.coalesce(F.nullif("lang", F.lit("en")), "source").alias("v"))


@query("f17_client_title", "SELECT doc_id, coalesce(nullif(CASE WHEN doc_id % 3 = 0 THEN source WHEN doc_id % 3 = 1 THEN '' END, ''), nullif(CASE WHEN doc_id % 2 = 0 THEN substring(text, 1, 40) ELSE '' END, ''), 'Новый диалог') AS title FROM documents")
def f17(spark, d):
    k = F.col("doc_id")
    title, last = F.when(k % 3 == 0, F.col("source")).when(k % 3 == 1, ""), F.when(k % 2 == 0, F.substring("text", 1, 40)).otherwise("")
    return table(spark, d, "documents").select("doc_id", fn.first_nonempty(title, last, F.lit("Новый диалог")).alias("title"))


@query("f18_badge", "SELECT event_id, CASE event_type WHEN 'click' THEN '🎤 ' WHEN 'view' THEN '📷 ' ELSE '' END AS badge FROM events")
def f18(spark, d):
    kind = F.when(F.col("event_type") == "click", "audio").when(F.col("event_type") == "view", "image").otherwise("text")
    return table(spark, d, "events").select("event_id", fn.input_badge(kind).alias("badge"))


@query("s3_json_body", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, length(props) BETWEEN 1 AND 8 AS ok FROM events")
def s3(spark, d):
    return table(spark, d, "events").select("event_id", json_body("props", "k bigint")["k"].alias("k"), valid_text(F.col("props"), 8).alias("ok"))


@query("s6_json_response", "SELECT r_regionkey, '{\"r_regionkey\":' || r_regionkey || ',\"r_name\":\"' || r_name || '\"}' AS body FROM region")
def s6(spark, d):
    return table(spark, d, "region").select("r_regionkey", json_response(["r_regionkey", "r_name"]).alias("body"))


@query("s7_literal_rows", "SELECT r_regionkey AS id, r_name AS name FROM region UNION ALL SELECT * FROM (VALUES (100, 'free'), (101, 'pro')) AS t(id, name)")
def s7(spark, d):
    """Seed rows beside those that a table has."""
    kept = table(spark, d, "region").select(F.col("r_regionkey").alias("id"), F.col("r_name").alias("name"))
    return kept.unionByName(literal(spark, [(100, "free"), (101, "pro")], "id int, name string").select(F.col("id").cast(kept.schema["id"].dataType).alias("id"), "name"))


@query("s5_media_messages", """
SELECT page_id, CASE WHEN page_id % 2 = 0 THEN 'audio' ELSE 'image' END AS kind, strlen(html) AS n_bytes, sha256(html) AS content_sha256,
       length('data:text/html;base64,' || to_base64(encode(html))) AS url_chars, substring(text, 1, 80) AS recognised, CASE WHEN text IS NULL OR trim(text) = '' THEN 400 ELSE 200 END AS status
FROM pages LEFT JOIN documents ON doc_id = page_id * 3
""")
def s5(spark, d):
    """Uploads as they come in, each with the text that was recognised in it: media without any are refused."""
    uploads = table(spark, d, "pages").select("page_id", F.when(F.col("page_id") % 2 == 0, "audio").otherwise("image").alias("kind"), F.encode("html", "UTF-8").alias("content"))
    heard = docs(spark, d).filter(F.col("doc_id") % 3 == 0).select((F.col("doc_id") / 3).cast("long").alias("page_id"), "text")
    media = media_messages(uploads, heard, "page_id")
    return media.select("page_id", "kind", F.octet_length("content").cast("long").alias("n_bytes"), F.sha2("content", 256).alias("content_sha256"), F.length(fn.data_url(F.lit("text/html"), F.col("content"))).cast("long").alias("url_chars"), fn.prefix(F.col("text"), 80).alias("recognised"), "status")


@query("p1_message_validity", "SELECT conv_id, turn, length(text) BETWEEN 1 AND 4000 AS valid, trim(text) = '' AS blank, text LIKE 'T%' AS starts, regexp_matches(text, '[0-9]') AS has_digit FROM conversations")
def p1(spark, d):
    t = F.col("text")
    return table(spark, d, "conversations").select("conv_id", "turn", valid_text(t).alias("valid"), (fn.strip(t) == "").alias("blank"), t.startswith("T").alias("starts"), t.rlike("[0-9]").alias("has_digit"))


@query("t1_annotations", "SELECT doc_id, CASE WHEN length(text) >= 9 THEN substring(text, 1, 2) || substring(text, 5, 2) || substring(text, 10) WHEN length(text) >= 4 THEN substring(text, 1, 2) || substring(text, 5) ELSE text END AS text FROM documents")
def t1(spark, d):
    span = lambda a, b: F.struct(F.lit(a).alias("start"), F.lit(b).alias("end"))
    spans = F.array(span(2, 4), span(6, 9), span(5, 5), span(-1, 3))
    return docs(spark, d).select("doc_id", answers.strip_annotations(F.col("text"), spans).alias("text"))


MARKED = r"""concat('  【4:0†x】 \(a\)   \[b\]  ', text, ' 【1】  ')"""
# Unicode white space at both ends, as strip() removes it.
ENDS = r"[\s\x1c-\x1f\x85\p{Z}]"


@query("t2_formatting", rf"SELECT doc_id, regexp_replace(regexp_replace(replace(replace(replace(replace(regexp_replace(concat('  【4:0†x】 \(a\)   \[b\]  ', text, ' 【1】  '), '【[^】]*】', '', 'g'), '\(', '$'), '\)', '$'), '\[', '$$'), '\]', '$$'), '  +', ' ', 'g'), '^{ENDS}+|{ENDS}+$', '', 'g') AS text FROM documents")
def t2(spark, d):
    marked = F.concat(F.lit("  【4:0†x】 \\(a\\)   \\[b\\]  "), F.col("text"), F.lit(" 【1】  "))
    return spread(docs(spark, d)).select("doc_id", answers.clean_formatting(marked).alias("text"))


T2A_SQL = f"SELECT doc_id, translate(concat('АВСДж ', text, ' хУ'), '{answers.CYRILLIC}', '{answers.LATIN}') AS text FROM documents"


@query("t2a_normalize_echo", T2A_SQL)
def t2a(spark, d):
    return docs(spark, d).select("doc_id", answers.normalize_echo(F.concat(F.lit("АВСДж "), F.col("text"), F.lit(" хУ"))).alias("text"))


# White space within a text, as Java's \\s has it in Unicode mode.
INNER_ASCII = r"[ \t\n\x0b\f\r]"
INNER = r"[\s\x0b\x85\p{Z}]"


@query("t2b_latex_in_documents", rf"""
SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(concat('\text{{cm}} \frac{{a}}{{b}} ', text, ' \sqrt{{x_1}}\alpha '),
  '\\text{INNER}*\{{([^}}]*)\}}', '\1', 'g'), '\\frac{INNER}*\{{([^}}]*)\}}\{{([^}}]*)\}}', '\1/\2', 'g'), '\\sqrt{INNER}*\{{([^}}]*)\}}', '√\1', 'g'),
  '\\[a-zA-Z]+', '', 'g'), '[{{}}_\\^]', '', 'g'), '{INNER}+', ' ', 'g'), '^{ENDS}+|{ENDS}+$', '', 'g') AS plain FROM documents
""")
def t2b_docs(spark, d):
    marked = F.concat(F.lit("\\text{cm} \\frac{a}{b} "), F.col("text"), F.lit(" \\sqrt{x_1}\\alpha "))
    return spread(docs(spark, d)).select("doc_id", answers.latex_to_plain(marked).alias("plain"))


# No SQL follows a scan whose look-ahead depends on the data; the tests compare with a scanner of characters.
@query("t3_echoes_in_documents", None)
def t3(spark, d):
    arrow_batches(spark)
    return spread(docs(spark, d)).select("doc_id", answers.remove_latex_echoes(F.concat(F.lit("$q_{1}$q1 "), F.col("text"))).alias("text"))


# DuckDB has no back-references; the tests compare with another engine's.
@query("t4_plain_echoes", None)
def t4(spark, d):
    return spread(docs(spark, d)).select("doc_id", answers.remove_plain_echoes(F.concat(F.lit("CD = 6,0CD = 6,0 см "), F.col("text"))).alias("text"))


@query("t5_braces_strict", r"SELECT doc_id, regexp_replace(concat('{a} ', text, ' {,} $x_{1}$ {b}'), '(\$\$[\s\S]*?\$\$|\$\$[\s\S]*|\$[^$]+\$|\$[^$]*)|[{}]', '\1', 'g') AS text FROM documents")
def t5(spark, d):
    return spread(docs(spark, d)).select("doc_id", answers.clean_outside_math(F.concat(F.lit("{a} "), F.col("text"), F.lit(" {,} $x_{1}$ {b}"))).alias("text"))


MATH = r"(\$\$[\s\S]*?\$\$|\$\$[\s\S]*|\$[^$]+\$|\$[^$]*)"


@query("t5_intended_in_documents", rf"""
WITH a AS (SELECT doc_id, regexp_replace(concat('{{a}} 5\text{{{{ см}}}} ', text, ' {{,}} \alpha{{b}} $x_{{1}}$ {{b}}'), '{MATH}|\{{(,)\}}', '\1\2', 'g') AS t FROM documents),
b AS (SELECT doc_id, regexp_replace(t, '{MATH}|\\text{INNER_ASCII}*\{{{INNER_ASCII}*([^}}]*)\}}', '\1\2', 'g') AS t FROM a)
SELECT doc_id, regexp_replace(regexp_replace(t, '{MATH}|\\[a-zA-Z]+', '\1', 'g'), '{MATH}|[{{}}]', '\1', 'g') AS text FROM b
""")
def t5_intended(spark, d):
    marked = F.concat(F.lit("{a} 5\\text{{ см}} "), F.col("text"), F.lit(" {,} \\alpha{b} $x_{1}$ {b}"))
    return spread(docs(spark, d)).select("doc_id", answers.clean_outside_math(marked, "intended").alias("text"))


@query("t6_display_in_documents", rf"""
WITH d AS (SELECT doc_id, concat('【1】', CASE WHEN doc_id % 2 = 0 THEN '\(a\) \[b\] p$$c$$q ' ELSE '' END, text, ' {{,}}' || repeat(chr(10), 6) || 'end ') AS t FROM documents),
e AS (SELECT doc_id, replace(replace(replace(replace(regexp_replace(t, '【[^】]*】', '', 'g'), '\(', '$'), '\)', '$'), '\[', '$'), '\]', '$') AS t FROM d),
f AS (SELECT doc_id, regexp_replace(regexp_replace(t, '([^\n])\$\$', '\1' || chr(10) || '$', 'g'), '\$\$([^\n])', '$' || chr(10) || '\1', 'g') AS t FROM e)
SELECT doc_id, regexp_replace(regexp_replace(CASE WHEN contains(t, '$') THEN t ELSE replace(t, '{{,}}', ',') END, '\n{{4,}}', repeat(chr(10), 3), 'g'), '^{ENDS}+|{ENDS}+$', '', 'g') AS text FROM f
""")
def t6_docs(spark, d):
    math = F.when(F.col("doc_id") % 2 == 0, "\\(a\\) \\[b\\] p$$c$$q ").otherwise("")
    shown = answers.display_text(F.concat(F.lit("【1】"), math, F.col("text"), F.lit(" {,}" + "\n" * 6 + "end ")))
    return spread(docs(spark, d)).select("doc_id", shown.alias("text"))


@query("a3_reply_text", "SELECT conv_id, coalesce(string_agg(text, '' ORDER BY turn) FILTER (role = 'assistant'), '') AS reply FROM conversations GROUP BY conv_id")
def a3(spark, d):
    block = F.struct("turn", F.when(F.col("role") == "assistant", "text").otherwise("image").alias("type"), F.col("text").alias("value"))
    return table(spark, d, "conversations").groupBy("conv_id").agg(answers.reply_text(F.array_sort(F.collect_list(block))).alias("reply"))


@query("a3_newest_reply", """
SELECT conv_id, turn, replace(text, chr(10), '') AS reply FROM conversations WHERE role = 'assistant' QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) = 1
""")
def a3_newest(spark, d):
    """The newest assistant message of each conversation, put together from its own text blocks: here its lines, with a picture between them."""
    replies = table(spark, d, "conversations").filter("role = 'assistant'")
    newest = latest_child(replies, "conv_id", ["turn"], ["turn", "text"])
    block = lambda kind: lambda x: F.struct(F.lit(kind).alias("type"), x.alias("value"))
    blocks = F.concat(F.array(F.struct(F.lit("image").alias("type"), F.lit("x.png").alias("value"))), F.transform(F.split("text", "\n"), block("text")))
    return newest.select("conv_id", "turn", answers.reply_text(blocks).alias("reply"))


@query("t_full_chain", None)
def chain(spark, d):
    arrow_batches(spark)
    marked = F.concat(F.lit("【1】 \\(q_{1}\\)q1  {x} "), F.col("text"))
    return spread(docs(spark, d)).select("doc_id", answers.clean_answer(marked).alias("text"))


# A string for each customer: keys and values that need decoding, a key that comes twice, one without a value, stray percent signs.
def init_rows(spark, d):
    k = F.col("c_custkey")
    n = k.cast("string")
    user = F.concat(F.lit("user=%7B%22id%22%3A"), n, F.when(k % 4 == 0, "").otherwise("%2C%22first_name%22%3A%22A%252BB+%25zz%22"), F.lit("%7D"))
    raw = F.concat(F.lit("z=50%&"), user, F.lit("&b%3Db=%D0%96+"), n, F.lit("&&z=twice&bare&auth_date="), (k * 1000).cast("string"), F.lit("&hash=h"))
    return dealt(table(spark, d, "customer").select(k), "c_custkey").select(k, F.when(k % 50 > 0, raw).alias("raw"))


@query("f6_parse_pairs", "SELECT c_custkey, CASE WHEN c_custkey % 50 > 0 THEN 'auth_date,b=b,bare,hash,user,z' END AS keys, CASE WHEN c_custkey % 50 > 0 THEN 'Ж ' || c_custkey || '|50%|' END AS some FROM customer")
def f6(spark, d):
    rows = init_rows(spark, d).withColumn("p", init_data.pairs(F.col("raw")))
    return rows.select("c_custkey", F.array_join(F.array_sort(F.map_keys("p")), ",").alias("keys"), F.concat(F.col("p")["b=b"], F.lit("|"), F.col("p")["z"], F.lit("|"), F.col("p")["bare"]).alias("some"))


@query("f8_init_user", "SELECT c_custkey, CASE WHEN c_custkey % 50 > 0 AND c_custkey % 4 > 0 THEN c_custkey END AS uid, CASE WHEN c_custkey % 50 > 0 AND c_custkey % 4 > 0 THEN 'A+B %zz' END AS first_name FROM customer")
def f8(spark, d):
    return init_rows(spark, d).withColumn("u", init_data.user(init_data.pairs(F.col("raw")))).select("c_custkey", F.col("u.id").alias("uid"), "u.first_name")


@query("f9_base_string", """
SELECT c_custkey, CASE WHEN c_custkey % 50 > 0 THEN 'auth_date=' || c_custkey * 1000 || chr(10) || 'b=b=Ж ' || c_custkey || chr(10) || 'bare=' || chr(10) || 'user={"id":' || c_custkey
       || CASE WHEN c_custkey % 4 = 0 THEN '' ELSE ',"first_name":"A%2BB %zz"' END || '}' || chr(10) || 'z=50%' END AS base FROM customer
""")
def f9(spark, d):
    return init_rows(spark, d).select("c_custkey", init_data.base_string(init_data.pairs(F.col("raw"))).alias("base"))


@query("f10_expiry", "SELECT c_custkey, c_custkey % 50 = 0 OR 500000 - c_custkey * 1000 > 86400 AS expired FROM customer")
def f10(spark, d):
    dates = init_rows(spark, d).withColumn("auth_date", init_data.pairs(F.col("raw"))["auth_date"])
    return dates.select("c_custkey", fn.is_expired(fn.int_or_null(F.col("auth_date")), F.lit(500_000)).alias("expired"))


@query("i1_resolve_id", "SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN c_custkey WHEN c_custkey % 5 = 1 THEN c_custkey + 1 WHEN c_custkey % 5 = 2 THEN 42 ELSE 0 END AS uid FROM customer")
def i1(spark, d):
    k = F.col("c_custkey")
    header = F.when(k % 5 == 1, (k + 1).cast("string")).when(k % 5 == 3, "bad")
    return table(spark, d, "customer").select("c_custkey", init_data.resolve_id(F.when(k % 5 == 0, k), header, F.when(k % 5 == 2, F.lit(42).cast("bigint"))).alias("uid"))
