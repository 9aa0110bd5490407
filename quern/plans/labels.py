"""Normal forms and predicates of label texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions import labels as L
from quern.functions import shapes as H
from quern.functions import texts as X
from quern.plans.registry import query
from quern.sources.tables import spread, table

RAW = "p_name || ' （x y）’–' || p_brand || CASE WHEN p_partkey % 3 = 0 THEN '(' || p_type || '[a{b}c])' ELSE '' END"


def raw_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part", "p_partkey", "p_name", "p_brand", "p_type", "p_size")
    return p.withColumn("raw", F.concat("p_name", F.lit(" （x y）’–"), "p_brand", F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("("), "p_type", F.lit("[a{b}c])"))).otherwise("")))


@query(f"""SELECT p_partkey, replace(p_name, ' ', '') || '-' || p_brand AS name, lower(replace(p_name, ' ', '')) || 'xy' || lower(replace(p_brand, '#', '')) || CASE WHEN p_partkey % 3 = 0 THEN lower(regexp_replace(p_type, '[^A-Za-z]', '', 'g')) || 'abc' ELSE '' END AS folded,
 p_name || ' ’–' || p_brand AS outside FROM part""")
def label_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lookup form, letters and digits only, and the text outside of nested brackets."""
    rows = raw_names(spark, sf_dir)
    return rows.select("p_partkey", L.label_name(F.col("raw")).alias("name"), L.folded(F.col("raw")).alias("folded"), L.outside_brackets(F.col("raw")).alias("outside"))


@query("""SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN p_name ELSE replace(p_name, ' ', '') END AS name FROM part""")
def item_cleanup(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part", "p_partkey", "p_name")
    even = F.concat(F.lit(" 、●含"), "p_name", F.lit("及其製品。 "))
    odd = F.concat(F.lit("添加"), F.replace("p_name", F.lit(" "), F.lit("")), F.lit("等 ●"))
    return p.select("p_partkey", L.item_name(F.when(F.col("p_partkey") % 2 == 0, even).otherwise(odd)).alias("name"))


@query("""SELECT p_partkey, p_partkey % 4 = 0 OR p_partkey % 4 = 1 OR p_size % 2 = 0 AND p_partkey % 4 = 3 AS note, CASE WHEN p_partkey % 5 < 2 THEN 1 + p_partkey % 5 ELSE p_partkey % 5 + 1 END::INT AS parts, p_partkey % 5 >= 2 AND p_partkey % 7 <> 0 AS compound FROM part""")
def notes_and_compounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Notes in brackets, and foods with their parts; a generic term before the bracket is no food."""
    p = table(spark, sf_dir, "part", "p_partkey", "p_name", "p_size")
    k = F.col("p_partkey")
    note = F.when(k % 4 == 0, "無水").when(k % 4 == 1, "70%").when(k % 4 == 2, F.col("p_name")).when(F.col("p_size") % 2 == 0, F.concat(F.lit("來自"), "p_name")).otherwise("a")
    inside = F.array_join(F.transform(F.sequence(F.lit(0), (k % 5).cast("int")), lambda i: F.concat("p_name", i.cast("string"))), "、")
    text = F.concat(F.when(k % 7 == 0, "複方色素").otherwise("sauce"), F.lit("("), inside, F.lit(" [x])"))
    return p.select("p_partkey", L.is_note(note).alias("note"), F.size(L.parts_of(text)).alias("parts"), L.is_compound(text, ["色素"]).alias("compound"))


@query("""SELECT doc_id, regexp_matches(text, '(^|[^0-9.])9(\\.0+)?([^0-9.]|\\.[^0-9]|\\.?$)') AS nine, regexp_matches(text, '(^|[^0-9.])2\\.50*([^0-9.]|\\.[^0-9]|\\.?$)') AS half FROM (SELECT doc_id, text || CASE doc_id % 6 WHEN 0 THEN ' 9.0 g' WHEN 1 THEN ' 19' WHEN 2 THEN ' 2.50' WHEN 3 THEN ' 2.55' WHEN 4 THEN ' (9)' ELSE '' END AS text FROM documents)""".replace("\\\\", "\\"))
def whole_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    tails = F.get(F.array(*map(F.lit, [" 9.0 g", " 19", " 2.50", " 2.55", " (9)", ""])), (F.col("doc_id") % 6).cast("int"))
    d = table(spark, sf_dir, "documents", "doc_id", "text").select("doc_id", F.concat("text", tails).alias("text"))
    return d.select("doc_id", L.number_present(F.lit("9"), F.col("text")).alias("nine"), L.number_present(F.lit("2.50"), F.col("text")).alias("half"))


@query("""SELECT page_id, CASE WHEN page_id % 4 IN (0, 2) THEN 'regulatory_or_authority' END AS scope FROM pages""")
def evidence_scopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages", "page_id", "url")
    url = F.when(F.col("page_id") % 4 == 0, F.concat("url", F.lit("?to=https://www.FDA.gov.tw"))).otherwise(F.col("url"))
    return p.select("page_id", L.evidence_scope(url, F.when(F.col("page_id") % 4 == 2, " Official ").otherwise("news")).alias("scope"))


@query("""SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN p_type || ' (' || p_name || ')' WHEN 1 THEN p_brand || ' (' || p_name || ')' ELSE p_name END AS shown FROM part""")
def display_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The English name, else the first alias in ASCII, in front of the name."""
    p, k = table(spark, sf_dir, "part", "p_partkey", "p_name", "p_brand", "p_type"), F.col("p_partkey") % 3
    aliases = F.when(k < 2, F.array(F.lit("別名"), F.col("p_brand"))).otherwise(F.array(F.lit("別名")))
    return p.select("p_partkey", L.display_name(F.col("p_name"), F.when(k == 0, F.col("p_type")).when(k == 1, " "), aliases).alias("shown"))


@query("""SELECT conv_id, turn, CASE WHEN trim(t) = '' THEN -100 ELSE CASE kind WHEN 'official' THEN 30 WHEN 'news' THEN 20 ELSE 0 END - CASE WHEN t LIKE '[PDF]%' THEN 20 ELSE 0 END - CASE WHEN lower(t) LIKE '%facebook%' THEN 15 ELSE 0 END + CASE WHEN length(t) BETWEEN 10 AND 45 THEN 5 ELSE 0 END END AS score,
 CASE WHEN turn % 3 = 1 THEN '維基百科' WHEN kind = 'official' THEN '官方公告' WHEN kind = 'news' THEN '新聞連結' ELSE '來源連結' END AS link
FROM (SELECT conv_id, turn, CASE role WHEN 'user' THEN 'official' WHEN 'assistant' THEN 'news' ELSE 'other' END AS kind, CASE conv_id % 5 WHEN 0 THEN '[PDF] ' || role WHEN 1 THEN role || ' | Facebook' WHEN 2 THEN '' WHEN 3 THEN regexp_replace(text, '^\\s+|\\s+$', '', 'g') ELSE 'A title of ' || role END AS t FROM conversations)""".replace("\\\\", "\\"))
def title_scores_and_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, k = table(spark, sf_dir, "conversations"), F.col("conv_id") % 5
    kind = F.when(F.col("role") == "user", "official").when(F.col("role") == "assistant", "news").otherwise("other")
    title = F.when(k == 0, F.concat(F.lit("[PDF] "), "role")).when(k == 1, F.concat("role", F.lit(" | Facebook"))).when(k == 2, "").when(k == 3, F.col("text")).otherwise(F.concat(F.lit("A title of "), "role"))
    url = F.when(F.col("turn") % 3 == 1, "https://zh.Wikipedia.org/x").otherwise("https://a.example/x")
    return c.select("conv_id", "turn", L.title_score(title, kind).alias("score"), L.link_label(url, kind).alias("link"))


@query("""SELECT p_partkey, left('p_' || replace(p_name, ' ', '_') || '_' || p_type || '_' || p_type || '_' || p_type || '_' || p_type, 40) AS label, CASE WHEN p_partkey % 3 = 0 THEN 'backend' ELSE left(p_name, 32) END AS reader, strlen('é' || p_name) - strlen(substr('é' || p_name, 4)) AS bytes,
 'uploads/' || p_partkey || '.jpg' AS path, p_partkey % 2 = 0 AS safe, p_name AS body FROM part""")
def small_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """File labels, reader ids, byte offsets, path prefixes and data addresses."""
    p, k = table(spark, sf_dir, "part", "p_partkey", "p_name", "p_type"), F.col("p_partkey")
    long = F.concat_ws(" / ", F.concat(F.lit("p "), "p_name"), "p_type", "p_type", "p_type", "p_type")
    reader = F.when(k % 3 == 0, "").otherwise(F.concat("p_name", F.lit(" (v2)")))
    path = F.concat(F.lit("/static/uploads/"), k.cast("string"), F.lit(".jpg"))
    odd = F.when(k % 2 == 0, path).otherwise(F.concat(path, F.lit("/../x")))
    return p.select(
        "p_partkey", L.clean_label(long).alias("label"), L.reader_id(reader, F.lit("backend")).alias("reader"), L.byte_offset(F.concat(F.lit("é"), "p_name"), F.lit(3)).cast("long").alias("bytes"),
        F.regexp_replace(path, "^/static/", "").alias("path"), odd.rlike(r"^/static/uploads/[\w\-]+\.(?:jpg|png)$").alias("safe"), L.without_data_prefix(F.concat(F.lit("data:text/plain;base64,"), "p_name")).alias("body"),
    )


@query("""SELECT event_id, CASE WHEN event_id % 4 = 3 THEN NULL ELSE json_extract_string(props, '$.k') END AS k, event_id % 4 <> 3 AND event_id % 4 <> 1 AS exact, CASE WHEN event_id % 4 = 1 THEN '7' ELSE NULL END AS other FROM events""")
def model_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON within an answer's text, its exact keys, and a value by one of two paths."""
    e, k = table(spark, sf_dir, "events", "event_id", "props"), F.col("event_id") % 4
    body = F.when(k == 1, F.replace("props", F.lit("}"), F.lit(', "z": {"y": 7}}'))).when(k == 3, "{broken").otherwise(F.col("props"))
    found = L.greedy_json(F.concat(F.lit("Sure: ```"), body, F.lit("``` done.")))
    rows = e.select("event_id", found.alias("j"))
    return rows.select("event_id", F.get_json_object("j", "$.k").alias("k"), L.has_exact_keys(F.col("j"), ["k"]).alias("exact"), F.coalesce(F.get_json_object("j", "$.x.y"), F.get_json_object("j", "$.z.y")).alias("other"))


@query("""SELECT p_partkey, array_to_string([replace(p_name, ' ', ''), p_type, p_brand], '|') AS names, CASE p_partkey % 4 WHEN 0 THEN 'pregnant' WHEN 1 THEN 'toddler' WHEN 2 THEN 'toddler' ELSE 'general' END AS grp FROM part""")
def names_and_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lists of names in one text; the first condition that has a group gives it."""
    p, k = table(spark, sf_dir, "part", "p_partkey", "p_name", "p_type", "p_brand"), F.col("p_partkey") % 4
    listed = F.concat("p_name", F.lit("; (x)；"), "p_type", F.lit("、"), "p_brand", F.lit(";"))
    conditions = F.when(k == 0, F.array(F.lit("孕婦"), F.lit("toddler"))).when(k == 1, F.array(F.lit("x"), F.lit(" 幼兒 "))).when(k == 2, F.array(F.lit(None).cast("string"), F.lit("toddler"), F.lit("孕婦"))).otherwise(F.array(F.lit("child")))
    return p.select("p_partkey", F.array_join(L.split_names(listed), "|").alias("names"), L.first_condition(conditions, {"孕婦": "pregnant", "toddler": "toddler", "幼兒": "toddler"}).alias("grp"))


@query("""SELECT p_partkey, array_to_string(list_filter(['a1', 'b3', 'c5'], lambda r: CASE r WHEN 'a1' THEN p_size > 10 WHEN 'b3' THEN p_size > 20 AND p_partkey % 3 <> 0 ELSE p_size > 30 END), ',') AS risks, p_size > 20 AND p_partkey % 3 <> 0 OR p_size > 30 AS attention FROM part""")
def risk_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Risks of known groups that have a source; any of level three or more asks for attention."""
    p = table(spark, sf_dir, "part", "p_partkey", "p_size")
    level = F.create_map(F.lit("caution"), F.lit(1), F.lit("avoid"), F.lit(3), F.lit("danger"), F.lit(5))
    group = F.create_map(F.lit("甲"), F.lit("a"), F.lit("乙"), F.lit("b"), F.lit("丙"), F.lit("c"))
    row = lambda g, concern, size, url: F.when(F.col("p_size") > size, F.struct(F.lit(g).alias("g"), F.lit(concern).alias("concern"), url.alias("url")))
    raw = F.array(row("甲", "caution", 10, F.lit("u")), row("乙", "avoid", 20, F.when(F.col("p_partkey") % 3 != 0, "u").otherwise("  ")), row("丁", "danger", 0, F.lit("u")), row("丙", "danger", 30, F.lit("u")))
    known = F.filter(raw, lambda r: r.isNotNull() & F.element_at(group, r["g"]).isNotNull() & (F.trim(r["url"]) != ""))
    rows = p.select("p_partkey", F.transform(known, lambda r: F.struct(F.element_at(group, r["g"]).alias("g"), F.element_at(level, r["concern"]).alias("level"))).alias("risks"))
    return rows.select("p_partkey", F.array_join(F.transform("risks", lambda r: F.concat(r["g"], r["level"].cast("string"))), ",").alias("risks"), F.exists("risks", lambda r: r["level"] >= 3).alias("attention"))


@query("""SELECT doc_id, coalesce(line, '') AS clause FROM documents LEFT JOIN (SELECT doc_id, arg_max(line, length(line) * 100000 - n) AS line FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM documents)
 WHERE regexp_matches(line, 'license|rights|the ') AND NOT regexp_matches(line, 'under|[0-9]{2}') AND length(line) >= 6 GROUP BY doc_id) USING (doc_id)""")
def warning_clauses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A text's longest line that says what it must and nothing that it must not."""
    d = table(spark, sf_dir, "documents", "doc_id", "text")
    good = F.filter(F.split("text", "\n"), lambda x: x.rlike("license|rights|the ") & ~x.rlike("under|[0-9]{2}") & (F.length(x) >= 6))
    best = F.array_min(F.transform(good, lambda x, i: F.struct((-F.length(x)).alias("n"), i.alias("i"), x.alias("x"))))
    return d.select("doc_id", F.coalesce(best["x"], F.lit("")).alias("clause"))


# Parts of labels from which each product gets its own, by its number; every third one is led by the product's name.
PARTS = ["砂糖", "棕櫚油", "食鹽", "檸檬酸(抗氧化劑E330)", "台南市新市區", "電話 02-123", "www.x.tw", "熱量12大卡34大卡", "小麥粉 水", "B1", "  ", "Vitamin", "乳 ab", "蛋白質5公克 6公克", "甜味劑" * 9, "某某股份有限公司", "卵磷脂", "α-β", "維生素（x）", "一二三四五六七八九"]
CHOSEN = f"""list_transform(range(1, 4 + p_size % 6), lambda i: CASE WHEN (p_partkey + i) % 3 = 0 THEN left(p_name, 2) ELSE '' END || {PARTS!r}[(p_partkey * (i * 7 + 3) + i * i) % {len(PARTS)} + 1])"""


def chosen_parts() -> Column:
    at = lambda i: ((F.col("p_partkey") * (i * 7 + 3) + i * i) % len(PARTS)).cast("int")
    led = lambda i: F.when((F.col("p_partkey") + i) % 3 == 0, F.left("p_name", F.lit(2))).otherwise("")
    return F.transform(F.sequence(F.lit(1), (F.lit(3) + F.col("p_size") % 6).cast("int")), lambda i: F.concat(led(i), F.get(F.array(*map(F.lit, PARTS)), at(i))))


@query(f"""SELECT p_partkey, sum(CASE WHEN n = 0 THEN 0 WHEN n BETWEEN 2 AND 12 AND share > 0.6 THEN 1 WHEN n > 40 THEN -2 WHEN share < 0.3 THEN -1 ELSE 0 END)::BIGINT AS plausible,
 count(*) FILTER (good AND n BETWEEN 1 AND 60) AS items, count(*) FILTER (good AND n BETWEEN 1 AND 8 AND NOT contains(trim(x), ' ')) AS strict
FROM (SELECT *, (share > 0.5 OR regexp_matches(x, '[(（]')) AND NOT regexp_matches(x, '{"|".join([*H.LONG_RUNS, *H.ELSEWHERE])}') AS good FROM (SELECT p_partkey, x, length(regexp_replace(x, '[^\\p{{L}}\\p{{N}}]', '', 'g')) AS n, length(regexp_replace(x, '[^一-鿿]', '', 'g')) / greatest(length(replace(x, ' ', '')), 1) AS share
FROM (SELECT p_partkey, unnest({CHOSEN}) AS x FROM part))) GROUP BY p_partkey""")
def item_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much a label's parts look like a list of ingredients, how many of them may be one, and how many are one by the strict rule."""
    rows = spread(table(spark, sf_dir, "part", "p_partkey", "p_name", "p_size")).select("p_partkey", chosen_parts().alias("parts"))
    count = lambda rule: F.size(F.filter("parts", rule)).cast("long")
    return rows.select("p_partkey", H.plausible(F.col("parts")).cast("long").alias("plausible"), count(H.looks_like_item).alias("items"), count(H.strict_item).alias("strict"))


@query(f"""SELECT p_partkey, NOT regexp_matches(t, '棕櫚油|卵磷脂') AND (len(regexp_extract_all(t, '{"|".join(H.NUTRITION)}')) >= 3 AND length(regexp_replace(t, '[^0-9]', '', 'g')) / greatest(length(t), 1) > 0.15
 OR len(regexp_extract_all(t, '{"|".join(H.ADDRESS)}')) >= 2) AS junk FROM (SELECT p_partkey, array_to_string({CHOSEN}, '') AS t FROM part)""")
def junk_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks of a label that are a nutrition table or an address and hold no known ingredient."""
    rows = table(spark, sf_dir, "part", "p_partkey", "p_name", "p_size").select("p_partkey", F.array_join(chosen_parts(), "").alias("t"))
    return rows.select("p_partkey", H.junk(F.col("t"), F.col("t").rlike("棕櫚油|卵磷脂")).alias("junk"))


@query(r"""SELECT item_id, len(s)::BIGINT AS n, array_to_string(CASE WHEN len(h) > 0 THEN h ELSE s[-1:] END, '。') AS essential, array_to_string(CASE WHEN len(h) > 0 THEN list_filter(s, lambda x: NOT (contains(x, 'the') OR contains(x, 'les'))) ELSE s[:-2] END, '。') AS remaining FROM (
  SELECT item_id, s, list_filter(s, lambda x: contains(x, 'the') OR contains(x, 'les')) AS h FROM (SELECT item_id, list_filter(list_transform(string_split(replace(replace(regexp_replace(text || ' Use 0.07 g', '([0-9])\.([0-9])', '\1#\2', 'g'), '.', '。'), '#', '.'), '。'), lambda s: regexp_replace(s, '^\s+|\s+$', '', 'g')), lambda s: s <> '') AS s FROM (SELECT item_id, replace(text, '#', '') AS text FROM benchmark)))""")
def sentence_digits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences with the full stops between digits kept; the essential ones and the rest."""
    b = table(spark, sf_dir, "benchmark").select("item_id", X.sentences(F.concat(F.replace("text", F.lit("#"), F.lit("")), F.lit(" Use 0.07 g"))).alias("s"))
    rows = b.select("item_id", "s", X.essential(F.col("s"), ["the", "les"]).alias("e"))
    rest = F.filter("s", lambda x, i: ~F.array_contains(F.col("e"), x))
    return rows.select("item_id", F.size("s").cast("long").alias("n"), F.array_join("e", "。").alias("essential"), F.array_join(rest, "。").alias("remaining"))


@query("""SELECT doc_id, block, min(n)::INT AS first_line, count(*) AS n_rows, count(*) FILTER (sep) AS n_separators, max(cells)::INT AS n_cells FROM (
 SELECT doc_id, n, len(c) AS cells, regexp_full_match(array_to_string(c, ''), '[-: ]*') AS sep, n - row_number() OVER (PARTITION BY doc_id ORDER BY n) AS block FROM (
  SELECT doc_id, n, list_transform(string_split(trim(line, '|'), '|'), lambda x: trim(x)) AS c FROM (
   SELECT doc_id, unnest(l) AS line, generate_subscripts(l, 1) AS n FROM (SELECT doc_id, list_transform(string_split(text, chr(10)), lambda x, i: CASE WHEN regexp_matches(x, '[aeiou]{2}') THEN CASE WHEN i % 3 = 2 THEN '|--|:-:|' ELSE '|' || x || '|x|' END ELSE x END) AS l FROM documents)) WHERE starts_with(line, '|'))) GROUP BY doc_id, block""")
def table_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables in texts: runs of neighbouring rows that begin with a bar, their separator rows and widths."""
    from pyspark.sql import Window

    marked = F.transform(F.split("text", "\n"), lambda x, i: F.when(~x.rlike("[aeiou]{2}"), x).when(i % 3 == 1, "|--|:-:|").otherwise(F.concat(F.lit("|"), x, F.lit("|x|"))))
    lines = table(spark, sf_dir, "documents", "doc_id", "text").select("doc_id", F.posexplode(marked).alias("at", "line")).where(F.startswith("line", F.lit("|")))
    cells = F.transform(F.split(F.regexp_replace("line", r"^\|+|\|+$", ""), r"\|"), lambda x: F.trim(x))
    rows = lines.select("doc_id", (F.col("at") + 1).alias("n"), cells.alias("c"))
    block = F.col("n") - F.row_number().over(Window.partitionBy("doc_id").orderBy("n"))
    rows = rows.select("doc_id", "n", F.size("c").alias("cells"), F.array_join("c", "").rlike("^[-: ]*$").alias("sep"), block.cast("long").alias("block"))
    return rows.groupBy("doc_id", "block").agg(F.min("n").alias("first_line"), F.count("*").alias("n_rows"), F.count_if("sep").alias("n_separators"), F.max("cells").alias("n_cells"))


@query("""SELECT doc_id, n, at_::INT AS from_line, lead(at_, 1, total + 1) OVER (PARTITION BY doc_id ORDER BY n)::INT AS to_line, header FROM (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY at_)::INT AS n, at_, total, header FROM (
 SELECT doc_id, unnest(l) AS header, generate_subscripts(l, 1) AS at_, len(l) AS total FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)) WHERE regexp_matches(header, '^[ADET]'))""")
def segments_by_header(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments of texts: a header line and all lines up to the next one."""
    from pyspark.sql import Window

    lines = F.split("text", "\n")
    d = table(spark, sf_dir, "documents", "doc_id", "text").select("doc_id", F.size(lines).alias("total"), F.posexplode(lines).alias("at", "header")).where(F.col("header").rlike("^[ADET]"))
    w = Window.partitionBy("doc_id").orderBy("at")
    return d.select("doc_id", F.row_number().over(w).alias("n"), (F.col("at") + 1).alias("from_line"), F.coalesce(F.lead("at").over(w) + 1, F.col("total") + 1).alias("to_line"), "header")


@query("""SELECT a.doc_id AS a, b.doc_id AS b FROM s a JOIN s b ON a.grp = b.grp AND a.doc_id < b.doc_id AND (a.year IS NULL OR b.year IS NULL OR a.year = b.year) AND len(list_intersect(a.sig, b.sig)) > 0""".replace("FROM s a JOIN s b", "FROM (Q) a JOIN (Q) b").replace("Q", """SELECT doc_id, source || lang || (n_chars // 50) AS grp, list_filter(['scum', 'license', 'rights', 'tionou'], lambda t: contains(text, t)) AS sig, CASE WHEN doc_id % 3 > 0 THEN (2020 + doc_id % 3)::VARCHAR END AS year FROM documents WHERE regexp_matches(text, 'scum|license|rights|tionou')"""))
def incident_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reports of one key that name a common incident and do not differ in a known year, by an equi-join on key and incident."""
    terms = F.filter(F.array(*map(F.lit, ["scum", "license", "rights", "tionou"])), lambda t: F.contains("text", t))
    key = F.concat("source", "lang", F.floor(F.col("n_chars") / 50).cast("string"))
    year = F.when(F.col("doc_id") % 3 > 0, (F.lit(2020) + F.col("doc_id") % 3).cast("string"))
    d = table(spark, sf_dir, "documents", "doc_id", "text", "source", "lang", "n_chars").select("doc_id", key.alias("grp"), year.alias("year"), F.explode(terms).alias("term"))
    side = lambda x: d.select("grp", "term", F.col("doc_id").alias(x), F.col("year").alias(f"year_{x}"))
    pairs = side("a").join(side("b"), ["grp", "term"]).where("a < b AND (year_a IS NULL OR year_b IS NULL OR year_a = year_b)")
    return pairs.select("a", "b").distinct()
