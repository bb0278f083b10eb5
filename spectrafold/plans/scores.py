"""Scores, labels, text extraction and renderings over the driver's tables."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spectrafold.operators import scores as sc
from spectrafold.registry import register
from spectrafold.session import table

c = F.col


@register("pattern_score", "SELECT p_partkey, round(least(greatest(0.5+CASE WHEN regexp_matches(lower(p_type),'promo|standard') THEN 0.2 ELSE 0 END+CASE WHEN regexp_matches(lower(p_type),'^(small|economy)') THEN -0.15 ELSE 0 END+CASE WHEN regexp_matches(lower(p_type),'medium') THEN 0.4 ELSE 0 END,0),1),6) AS score FROM part")
def pattern_score(spark, d):
    return table(spark, d, "part").select("p_partkey", F.round(sc.pattern_score(c("p_type"), {"promo|standard": 0.2, "^(small|economy)": -0.15, "medium": 0.4}), 6).alias("score"))


def _hits(text, words):
    return "(" + "+".join(f"contains(lower({text}),'{w}')::INT" for w in words) + ")"


_STRONG, _HEDGED = ["the", "and", "all"], ["on", "or"]


@register("claim_strength", f"WITH h AS (SELECT doc_id, {_hits('text', _STRONG)} s, {_hits('text', _HEDGED)} h FROM documents WHERE text IS NOT NULL) SELECT doc_id, round(CASE WHEN s+h=0 THEN 0.4 ELSE least(s/(s+h)+CASE WHEN s>=3 AND h=0 THEN 0.2 ELSE 0 END,1) END,6) AS strength FROM h")
def claim_strength(spark, d):
    return table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", F.round(sc.claim_strength(c("text"), _STRONG, _HEDGED), 6).alias("strength"))


_DOMAINS = {"colour": ["red", "blue", "green"], "item": ["widget", "bolt"], "size": ["small", "large", "medium"]}
_LISTED = ",".join(f"{{s:{_hits('p_name', w)}/{float(len(w))}::DOUBLE,p:-{i},n:'{n}'}}" for i, (n, w) in enumerate(_DOMAINS.items()))


@register("keyword_domain", f"WITH x AS (SELECT p_partkey, [{_LISTED}] l FROM part), b AS (SELECT p_partkey, l, list_max(l) b FROM x) SELECT p_partkey, CASE WHEN b.s>0 THEN b.n END AS domain, round(b.s,6) AS score, array_to_string(list_sort(list_transform(list_filter(l, lambda e: e.s>0.3 AND e.n<>b.n), lambda e: e.n)),',') AS secondary FROM b")
def keyword_domain(spark, d):
    out = table(spark, d, "part").select("p_partkey", sc.keyword_domain(c("p_name"), _DOMAINS).alias("k"))
    return out.select("p_partkey", "k.domain", F.round("k.score", 6).alias("score"), F.array_join("k.secondary", ",").alias("secondary"))


@register("checklist", "SELECT o_orderkey, ((o_totalprice>100000)::INT+(o_orderstatus='F')::INT+(o_orderpriority LIKE '1%')::INT+(o_custkey%2=0)::INT)/4.0::DOUBLE AS score, round(least(greatest(1-0.15*(o_orderkey%4)-0.05*(o_custkey%5)+CASE WHEN o_orderstatus='F' THEN 0.05 ELSE 0 END,0),1),6) AS rigor FROM orders")
def checklist(spark, d):
    checks = [c("o_totalprice") > 100000, c("o_orderstatus") == "F", c("o_orderpriority").like("1%"), c("o_custkey") % 2 == 0]
    return table(spark, d, "orders").select("o_orderkey", sc.checklist(checks).alias("score"), F.round(sc.penalised(c("o_orderkey") % 4, c("o_custkey") % 5, [c("o_orderstatus") == "F"]), 6).alias("rigor"))


@register("tiered_penalty", "SELECT o_orderkey, round(1-CASE WHEN o_totalprice>400000 THEN 0.5 WHEN o_totalprice>200000 THEN 0.3 WHEN o_totalprice>50000 THEN 0.1 ELSE 0 END,6) AS feasibility FROM orders")
def tiered_penalty(spark, d):
    return table(spark, d, "orders").select("o_orderkey", F.round(1 - sc.tiered_penalty(c("o_totalprice"), [(400000, 0.5), (200000, 0.3), (50000, 0.1)]), 6).alias("feasibility"))


@register("weighted_score", "SELECT l_orderkey, l_linenumber, l_partkey, round((coalesce(l_discount*10,0.5)*3+coalesce(CASE WHEN l_returnflag<>'A' THEN l_tax*10 END,0.5)*1)/4,6) AS score FROM lineitem")
def weighted_score(spark, d):
    li = table(spark, d, "lineitem").withColumn("a", c("l_discount") * 10).withColumn("b", F.when(c("l_returnflag") != "A", c("l_tax") * 10))
    return li.select("l_orderkey", "l_linenumber", "l_partkey", F.round(sc.weighted({"a": 3.0, "b": 1.0}), 6).alias("score"))


@register("evidence_strength", """WITH s AS (SELECT l_orderkey o, l_linenumber n, l_partkey k, CASE WHEN l_returnflag='A' THEN NULL ELSE l_tax END p, l_discount*10 e, l_quantity*4 q FROM lineitem),
 t AS (SELECT *, CASE WHEN p<0.001 THEN 1.0 WHEN p<0.01 THEN 0.8 WHEN p<0.05 THEN 0.6 WHEN p IS NOT NULL THEN 0.2 END a, CASE WHEN e>=0.8 THEN 1.0 WHEN e>=0.5 THEN 0.7 WHEN e>=0.2 THEN 0.4 ELSE 0.1 END b, CASE WHEN q>=100 THEN 1.0 WHEN q>=30 THEN 0.6 ELSE 0.3 END c FROM s)
SELECT o AS l_orderkey, n AS l_linenumber, k AS l_partkey, round((coalesce(0.4*a,0)+0.4*b+0.2*c)/(CASE WHEN a IS NULL THEN 0.6 ELSE 1.0 END),5)::DOUBLE AS strength, CASE WHEN p IS NULL THEN 'unknown' WHEN p<0.05 AND e>0.2 THEN 'true' ELSE 'false' END AS support FROM t""")
def evidence_strength(spark, d):
    p = F.when(c("l_returnflag") != "A", c("l_tax"))
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.round(sc.evidence_strength(p, c("l_discount") * 10, c("l_quantity") * 4), 5).alias("strength"), F.coalesce(sc.support(p, c("l_discount") * 10).cast("string"), F.lit("unknown")).alias("support"))


@register("composite_evidence", """WITH s AS (SELECT l_orderkey o, l_linenumber n, l_partkey k, pow(10,-l_quantity/5-0.05) p, l_discount*5-0.2 b, l_tax*10 q, l_tax-0.04 x, CASE WHEN l_returnflag<>'A' THEN l_discount-0.05 END y, l_returnflag f, l_linestatus g FROM lineitem),
 t AS (SELECT *, least(CASE WHEN p<5e-8 THEN 10 WHEN p<1e-5 THEN 7 WHEN p<1e-3 THEN 4 ELSE 0 END+CASE WHEN abs(b)>0.3 THEN 5 WHEN abs(b)>0.1 THEN 3 ELSE 0 END+floor(q*10)+CASE WHEN f='R' THEN 5 ELSE 0 END+CASE WHEN g='F' THEN 5 ELSE 0 END,55)::INT c FROM s)
SELECT o AS l_orderkey, n AS l_linenumber, k AS l_partkey, c AS score, CASE WHEN c>=20 THEN 'high' WHEN c>=12 THEN 'moderate' ELSE 'low' END AS level, CASE WHEN b>0 THEN 'increases' WHEN b<0 THEN 'decreases' ELSE 'none' END AS direction,
 coalesce(CASE WHEN y IS NULL THEN sign(b)=sign(x) AND sign(b)<>0 ELSE sign(b)=sign(x) AND sign(x)=sign(y) AND sign(b)<>0 END, false) AS concordant FROM t""")
def composite_evidence(spark, d):
    li = table(spark, d, "lineitem").withColumns({"p": F.pow(F.lit(10.0), -c("l_quantity") / 5 - 0.05), "b": c("l_discount") * 5 - 0.2, "x": c("l_tax") - 0.04, "y": F.when(c("l_returnflag") != "A", c("l_discount") - 0.05)})
    li = li.withColumn("score", sc.composite(c("p"), c("b"), c("l_tax") * 10, [c("l_returnflag") == "R", c("l_linestatus") == "F"]))
    return li.select("l_orderkey", "l_linenumber", "l_partkey", "score", sc.level(c("score"), [(20, "high"), (12, "moderate")], "low").alias("level"), sc.direction(c("b")).alias("direction"), sc.same_sign([c("b"), c("x"), c("y")]).alias("concordant"))


@register("volcano", "SELECT l_orderkey, l_linenumber, l_partkey, round(CASE WHEN l_tax<=0 THEN 100 ELSE -log10(l_tax) END,6)::DOUBLE AS height, CASE WHEN l_tax<0.05 AND l_discount*40-2>=1 THEN 'up' WHEN l_tax<0.05 AND l_discount*40-2<=-1 THEN 'down' ELSE 'ns' END AS point FROM lineitem")
def volcano(spark, d):
    out = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", sc.volcano(c("l_tax"), c("l_discount") * 40 - 2).alias("v"))
    return out.select("l_orderkey", "l_linenumber", "l_partkey", F.round("v.height", 6).alias("height"), F.col("v.class").alias("point"))


@register("name_class", "SELECT p_partkey, CASE WHEN trim(lower(p_name)) IN ('red widget') THEN 'token' WHEN ends_with(trim(lower(p_name)),'bolt') OR ends_with(trim(lower(p_name)),'ring') THEN 'fitting' WHEN contains(lower(p_name),'small') THEN 'small' ELSE 'other' END AS kind FROM part")
def name_class(spark, d):
    return table(spark, d, "part").select("p_partkey", sc.name_class(c("p_name"), {"token": ["red widget"]}, {"fitting": ["bolt", "ring"]}, {"small": ["small"]}).alias("kind"))


@register("stopword_jaccard", """WITH w AS (SELECT conv_id, turn, list_distinct(list_filter(regexp_extract_all(lower(text),'[a-z]{3,}'), lambda x: x NOT IN ('the','and'))) s FROM conversations)
SELECT a.conv_id AS conv_id, a.turn AS turn, round(CASE WHEN len(list_distinct(list_concat(a.s,b.s)))>0 THEN len(list_intersect(a.s,b.s))/len(list_distinct(list_concat(a.s,b.s))) ELSE 0 END,6) AS similarity,
 round(CASE WHEN len(list_distinct(list_concat(a.s,b.s)))=0 THEN 1.0 WHEN len(list_intersect(a.s,b.s))/len(list_distinct(list_concat(a.s,b.s)))>=0.9 THEN 0 WHEN len(list_intersect(a.s,b.s))/len(list_distinct(list_concat(a.s,b.s)))<0.3 THEN 1 ELSE 1-(len(list_intersect(a.s,b.s))/len(list_distinct(list_concat(a.s,b.s)))-0.3)/0.6 END,6)::DOUBLE AS novelty
 FROM w a JOIN w b ON a.conv_id=b.conv_id AND b.turn=a.turn+1""")
def stopword_jaccard(spark, d):
    w = table(spark, d, "conversations").select("conv_id", "turn", sc.token_set(c("text"), 3, ["the", "and"]).alias("s"))
    after = w.select("conv_id", (c("turn") - 1).alias("turn"), c("s").alias("other"))
    return w.join(after, ["conv_id", "turn"]).withColumn("x", sc.jaccard(c("s"), c("other"))).select("conv_id", "turn", F.round("x", 6).alias("similarity"), F.round(sc.novelty(c("x")), 6).alias("novelty"))


@register("finding_similarity", """WITH f AS (SELECT l_orderkey, l_linenumber, l_partkey, l_discount-0.05 e, l_tax p, l_returnflag k, lag(l_discount-0.05) OVER w f, lag(l_tax) OVER w q, lag(l_returnflag) OVER w j FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate))
SELECT l_orderkey, l_linenumber, l_partkey, round(0.6*0.5+0.3*(CASE WHEN sign(f)<>sign(e) THEN 0 ELSE least(abs(f),abs(e))/greatest(abs(f),abs(e),1e-12) END+((q<0.05)=(p<0.05))::INT)/2+0.1*(j=k)::INT,5)::DOUBLE AS similarity FROM f WHERE j IS NOT NULL""")
def finding_similarity(spark, d):
    """Each line of an order and the line before it."""
    w = W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate")
    f = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", (c("l_discount") - 0.05).alias("e"), c("l_tax").alias("p"), c("l_returnflag").alias("k"), F.lag(c("l_discount") - 0.05).over(w).alias("f"), F.lag("l_tax").over(w).alias("q"), F.lag("l_returnflag").over(w).alias("j"))
    like = sc.blended(F.lit(0.5), sc.result_similarity(c("f"), c("e"), c("q"), c("p")), c("j") == c("k"))
    return f.where("j IS NOT NULL").select("l_orderkey", "l_linenumber", "l_partkey", F.round(like, 5).alias("similarity"))


@register("numbers_in_text", """WITH t AS (SELECT event_id, 'p = 0.' || lpad((floor(value*100)::BIGINT%10000)::VARCHAR,4,'0') || ', r=-0.' || lpad((floor(value*50)::BIGINT%10000)::VARCHAR,4,'0') || ' n = ' || user_id::VARCHAR s FROM events)
SELECT event_id, list_min(list_transform(regexp_extract_all(s,'p = ([0-9.]+)',1), lambda x: x::DOUBLE)) AS min_p, list_max(list_transform(regexp_extract_all(s,'r=-([0-9.]+)',1), lambda x: x::DOUBLE)) AS max_r, list_max(list_transform(regexp_extract_all(s,'n = ([0-9]+)',1), lambda x: x::DOUBLE)) AS max_n FROM t""")
def numbers_in_text(spark, d):
    digits = lambda times: F.lpad((F.floor(c("value") * times) % 10000).cast("string"), 4, "0")
    said = F.concat(F.lit("p = 0."), digits(100), F.lit(", r=-0."), digits(50), F.lit(" n = "), c("user_id").cast("string"))
    return table(spark, d, "events").select("event_id", sc.numbers_in(said).alias("x")).select("event_id", "x.*")


@register("head_and_tail", "SELECT doc_id, md5(CASE WHEN length(text)<=200 THEN text ELSE substr(text,1,100) || chr(10) || '...' || chr(10) || right(text,100) END) AS sample FROM documents")
def head_and_tail(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(sc.head_and_tail(c("text"), 200)).alias("sample"))


@register("citations_in_text", """WITH t AS (SELECT page_id, 'see (Lee et al., 20' || (page_id%50+10)::VARCHAR || ') and [' || page_id::VARCHAR || ', 7], doi 10.1000/x' || (page_id%9)::VARCHAR || ' [7]' s FROM pages)
SELECT page_id, array_to_string(list_sort(list_distinct(list_concat(list_concat(regexp_extract_all(s,'\\(([A-Z][A-Za-z]+(?: et al\\.)?,? [0-9]{4})\\)',1),regexp_extract_all(s,'\\[([0-9]+(?:, ?[0-9]+)*)\\]',1)),regexp_extract_all(s,'(10\\.[0-9]{4,}/[^\\s)\\]]+)',1)))),'|') AS found FROM t""")
def citations_in_text(spark, d):
    k = c("page_id")
    said = F.concat(F.lit("see (Lee et al., 20"), (k % 50 + 10).cast("string"), F.lit(") and ["), k.cast("string"), F.lit(", 7], doi 10.1000/x"), (k % 9).cast("string"), F.lit(" [7]"))
    return table(spark, d, "pages").select("page_id", F.array_join(sc.citations_in(said), "|").alias("found"))


@register("clean_text", r"""WITH a AS (SELECT doc_id, replace(regexp_replace(text,'(\p{L})-\n(\p{L})','\1\2','g'), chr(10) || chr(10), chr(1) || chr(1)) s FROM documents), b AS (SELECT doc_id, replace(replace(replace(s, chr(1) || chr(10), chr(1) || chr(1)), chr(10), ' '), chr(1), chr(10)) s FROM a)
SELECT doc_id, md5(trim(regexp_replace(regexp_replace(s,'[ \t]+',' ','g'),'\n{3,}',chr(10) || chr(10),'g'),' ')) AS text_md5 FROM b""")
def clean_text(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(sc.clean_text(c("text"))).alias("text_md5"))


@register("json_blocks", "SELECT event_id, (props->>'k')::BIGINT AS k FROM events")
def json_blocks(spark, d):
    return table(spark, d, "events").select("event_id", sc.parsed_json(F.concat(F.lit("out: "), "props", F.lit("\ndone")), "k bigint")["k"].alias("k"))


@register("keywords", "SELECT conv_id, turn, array_to_string(list_slice(list_transform(list_sort(list_transform(list_distinct(list_filter(regexp_extract_all(lower(text),'[a-z]{3,}'), lambda x: x NOT IN ('the','and'))), lambda w: {n:-length(w), w:w})), lambda s: s.w),1,4),' ') AS words FROM conversations")
def keywords(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", F.array_join(sc.keywords(c("text"), ["the", "and"], 4), " ").alias("words"))


@register("article_id", r"""WITH t AS (SELECT page_id, CASE page_id%4 WHEN 0 THEN 'arXiv:' || k || 'v2' WHEN 1 THEN 'https://arxiv.org/pdf/' || k || 'v11.pdf' WHEN 2 THEN ' ' || k ELSE url END s FROM (SELECT *, regexp_extract(url,'([0-9]+)',1) || '.' || lpad(strlen(html)::VARCHAR,5,'0') k FROM pages))
SELECT page_id, regexp_replace(regexp_replace(trim(s),'^(https?://[^/]+/(abs|pdf)/|arXiv:)',''),'(v[0-9]+)?([.]pdf)?$','') AS id FROM t""")
def article_id(spark, d):
    k = F.concat(F.regexp_extract("url", "([0-9]+)", 1), F.lit("."), F.lpad(F.octet_length("html").cast("string"), 5, "0"))
    which = c("page_id") % 4
    said = F.when(which == 0, F.concat(F.lit("arXiv:"), k, F.lit("v2"))).when(which == 1, F.concat(F.lit("https://arxiv.org/pdf/"), k, F.lit("v11.pdf"))).when(which == 2, F.concat(F.lit(" "), k)).otherwise(c("url"))
    return table(spark, d, "pages").select("page_id", sc.article_id(said).alias("id"))


@register("cache_key", "SELECT o_orderkey, sha256('price=' || round(o_totalprice,2)::DECIMAL(18,2)::VARCHAR || '&status=' || o_orderstatus) AS cache_key FROM orders")
def cache_key(spark, d):
    return table(spark, d, "orders").select("o_orderkey", sc.cache_key({"status": c("o_orderstatus"), "price": F.round("o_totalprice", 2).cast("decimal(18,2)")}).alias("cache_key"))


@register("scored_sort", """SELECT o_orderkey, round(least(o_totalprice/10000/10,100)+50*(o_custkey%5)/5+30*(o_custkey%3)/3+CASE WHEN 1998-year(o_orderdate)<=5 THEN 4*(5-(1998-year(o_orderdate))) ELSE 0 END,6) AS relevance,
 round(0.4*(o_custkey%5)/5+0.3*least(ln(1+o_totalprice/10000)/ln(1001),1)+0.2*greatest(0,1-(1998-year(o_orderdate))/5),6) AS weighted FROM orders ORDER BY 2 DESC, 1 LIMIT 100""")
def scored_sort(spark, d):
    k, year = c("o_custkey"), F.year("o_orderdate")
    out = table(spark, d, "orders").select("o_orderkey", F.round(sc.relevance(c("o_totalprice") / 10000, k % 5 / 5, k % 3 / 3, year, 1998), 6).alias("relevance"), F.round(sc.weighted_relevance(k % 5 / 5, c("o_totalprice") / 10000, year, 1998), 6).alias("weighted"))
    return out.orderBy(F.desc("relevance"), "o_orderkey").limit(100)


@register("resource_estimate", "SELECT o_orderkey, round(CASE WHEN o_orderstatus='F' THEN 2.0 ELSE 1.0 END*(1+(o_custkey%3)*0.5)*least(greatest((o_orderkey%30)/5.0,0.5),3.0)*CASE WHEN o_totalprice>10000 THEN 2.0 WHEN o_totalprice>1000 THEN 1.5 ELSE 1.0 END,6)::DOUBLE AS effort FROM orders")
def resource_estimate(spark, d):
    base = F.when(c("o_orderstatus") == "F", 2.0).otherwise(1.0)
    return table(spark, d, "orders").select("o_orderkey", F.round(sc.resources(base, 1 + (c("o_custkey") % 3) * 0.5, c("o_orderkey") % 30, c("o_totalprice")), 6).alias("effort"))


@register("human_size", "SELECT page_id, CASE WHEN strlen(html)*1000>=1048576 THEN round(strlen(html)*1000/1048576.0,1)::DECIMAL(20,1)::VARCHAR || 'M' WHEN strlen(html)*1000>=1024 THEN round(strlen(html)*1000/1024.0,1)::DECIMAL(20,1)::VARCHAR || 'K' ELSE (strlen(html)*1000)::VARCHAR || 'B' END AS size FROM pages")
def human_size(spark, d):
    return table(spark, d, "pages").select("page_id", sc.format_size(F.octet_length("html") * 1000).alias("size"))


@register("casing_style", """WITH n AS (SELECT doc_id, regexp_extract_all(text,'[A-Z][A-Za-z0-9-]*') n FROM documents)
SELECT doc_id, CASE WHEN len(n)=0 THEN 'none' WHEN len(list_filter(n, lambda x: regexp_full_match(x,'[A-Z0-9-]+')))/len(n)>=0.6 THEN 'upper' WHEN len(list_filter(n, lambda x: regexp_full_match(x,'[A-Z][a-z0-9-]+')))/len(n)>=0.6 THEN 'title' ELSE 'mixed' END AS style FROM n""")
def casing_style(spark, d):
    """The words of each document that begin with a capital."""
    return table(spark, d, "documents").select("doc_id", sc.casing(F.regexp_extract_all("text", F.lit("[A-Z][A-Za-z0-9-]*"), F.lit(0))).alias("style"))


@register("routing", """SELECT o_orderkey, CASE WHEN o_totalprice>300000 AND o_orderstatus='F' THEN 'accept' WHEN o_totalprice>150000 THEN 'defer' ELSE 'reject' END AS decision, concat_ws('; ', CASE WHEN o_totalprice<=150000 THEN 'too small' END, CASE WHEN o_orderstatus<>'F' THEN 'open' END) AS reasons FROM orders""")
def routing(spark, d):
    price, status = c("o_totalprice"), c("o_orderstatus")
    return table(spark, d, "orders").select("o_orderkey", sc.decide([((price > 300000) & (status == "F"), "accept"), (price > 150000, "defer")], "reject").alias("decision"), sc.reasons([(price <= 150000, "too small"), (status != "F", "open")]).alias("reasons"))


@register("missing_fields", "SELECT page_id, concat_ws(',', CASE WHEN page_id%3=0 THEN 'url' END, CASE WHEN page_id%4=0 THEN 'html' END) AS missing FROM pages WHERE page_id%3=0 OR page_id%4=0")
def missing_fields(spark, d):
    pages = table(spark, d, "pages").select("page_id", F.when(c("page_id") % 3 != 0, c("url")).alias("url"), F.when(c("page_id") % 4 == 0, " ").otherwise(c("html")).alias("html"))
    return pages.select("page_id", F.array_join(sc.missing_fields(["url", "html"]), ",").alias("missing")).where("missing <> ''")


@register("rendered_entries", r"""SELECT s_suppkey, '@article{s' || s_suppkey::VARCHAR || ',' || chr(10) || '  author = {' || s_name || '},' || chr(10) || '  year = {' || (1990+s_nationkey)::VARCHAR || '}' || chr(10) || '}' AS bibtex,
 'TY  - JOUR' || chr(10) || 'AU  - ' || s_name || chr(10) || 'AU  - Other' || chr(10) || 'PY  - ' || (1990+s_nationkey)::VARCHAR || chr(10) || 'ER  - ' AS ris, s_name || ' (' || (1990+s_nationkey)::VARCHAR || '). Parts. Trade.' AS apa,
 s_name || ', "Parts," Trade, ' || (1990+s_nationkey)::VARCHAR || '.' AS ieee FROM supplier""")
def rendered_entries(spark, d):
    year, name, k = 1990 + c("s_nationkey"), c("s_name"), c("s_suppkey")
    return table(spark, d, "supplier").select(
        "s_suppkey", sc.bibtex(F.lit("article"), F.concat(F.lit("s"), k.cast("string")), {"author": name, "title": F.lit(""), "year": year}).alias("bibtex"),
        sc.ris(F.lit("JOUR"), {"PY": year, "T1": F.lit(None).cast("string")}, F.array(name, F.lit("Other"))).alias("ris"),
        sc.citation("apa", name, year, F.lit("Parts"), F.lit("Trade")).alias("apa"), sc.citation("ieee", name, year, F.lit("Parts"), F.lit("Trade")).alias("ieee"),
    )


@register("bibliography", "SELECT row_number() OVER (ORDER BY s_nationkey, s_name)::INT AS number, s_name || '. Parts. Trade. ' || (1990+s_nationkey)::VARCHAR || '.' AS entry FROM supplier")
def bibliography(spark, d):
    from spectrafold.operators.statistics import numbered

    year = 1990 + c("s_nationkey")
    return numbered(table(spark, d, "supplier"), ["s_nationkey", "s_name"], "number").select("number", sc.citation("vancouver", c("s_name"), year, F.lit("Parts"), F.lit("Trade")).alias("entry"))


@register("variable_findings", "SELECT 'l_' || f AS name, f || ': mean ' || round(m,2)::DECIMAL(18,2)::VARCHAR AS said FROM (SELECT l_returnflag f, avg(l_quantity) m FROM lineitem GROUP BY 1)")
def variable_findings(spark, d):
    m = table(spark, d, "lineitem").groupBy("l_returnflag").agg(F.avg("l_quantity").alias("m"))
    return m.select(F.concat(F.lit("l_"), "l_returnflag").alias("name"), F.concat("l_returnflag", F.lit(": mean "), F.round("m", 2).cast("decimal(18,2)").cast("string")).alias("said"))


