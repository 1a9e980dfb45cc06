"""Registered catalog query, search, paging and suggestion queries (C1-C3,
F5-F7, J1, J8, T1, T7, T9, A8, A13)."""

from __future__ import annotations

from pyspark.sql import functions as F

from shoplytics.operators import search as se
from shoplytics.plans.catalog import HARVEST_SQL, catalog_snapshot
from shoplytics.plans.registry import register
from shoplytics.session import stored
from shoplytics.sources import bindings
from shoplytics.sources.tables import table
from shoplytics.streaming.runner import scratch


def _fold_sql(x: str) -> str:
    s = f"translate(lower({x}), '{se.FOLD_FROM}', '{se.FOLD_TO}')"
    for a, b in se.FOLD_MULTI:
        s = f"replace({s}, '{a}', '{b}')"
    return s


def _raw_terms_sql(keys: str, text: str, of: str) -> str:
    """(keys, term): distinct unigrams and bigrams of at least three characters of every row's text."""
    return f"""SELECT {keys}, unnest(list_distinct(list_filter(
    list_concat(toks, list_transform(range(1, len(toks)), lambda i: toks[i] || ' ' || toks[i + 1])),
    lambda x: length(x) >= {se.MIN_TERM_LENGTH}))) AS term
  FROM (SELECT {keys}, regexp_extract_all({_fold_sql(text)}, '{se.TOKEN_PATTERN}') AS toks FROM {of})"""


# The stemmer once more, as SQL: s marks vowels (v) and consonants (c) letter by letter.
_SHAPE = """list_reduce(list_concat([''], string_split(w, '')), lambda s, c: s || CASE
  WHEN c IN ('a', 'e', 'i', 'o', 'u') OR (c = 'y' AND right(s, 1) = 'c') THEN 'v' ELSE 'c' END)"""
_CLOSED = "{s} LIKE '%cvc' AND right({w}, 1) NOT IN ('w', 'x', 'y')"


def _shaped(of: str) -> str:
    return f"SELECT t, w, {_SHAPE} AS s FROM ({of})"


def _first_rule(rules: str, test: str) -> str:
    """``old>new`` rules, the longest endings first: the first ending that fits decides."""
    out = ""
    for rule in sorted(rules.split(), key=lambda r: -len(r.split(">")[0])):
        old, new = rule.split(">")
        n = len(old)
        behind = " AND substr(w, length(w) - 3, 1) IN ('s', 't')" if old == "ion" else ""
        out += (f" WHEN ends_with(w, '{old}'){behind} THEN CASE WHEN left(s, length(s) - {n}) LIKE '{test}' "
                f"THEN left(w, length(w) - {n}) || '{new}' ELSE w END")
    return f"CASE{out} ELSE w END"


_STEP1 = """SELECT term AS t, CASE WHEN term LIKE '%sses' OR term LIKE '%ies' THEN left(term, length(term) - 2)
  WHEN term LIKE '%s' AND term NOT LIKE '%ss' THEN left(term, length(term) - 1) ELSE term END AS w FROM raw"""
_STEP2 = f"""SELECT t, CASE
  WHEN w LIKE '%eed' AND left(s, length(s) - 3) LIKE '%vc%' THEN left(w, length(w) - 1)
  WHEN cut = 0 THEN w
  WHEN x LIKE '%at' OR x LIKE '%bl' OR x LIKE '%iz' THEN x || 'e'
  WHEN length(x) > 1 AND right(x, 1) = substr(x, length(x) - 1, 1) AND xs LIKE '%c'
    THEN CASE WHEN right(x, 1) IN ('l', 's', 'z') THEN x ELSE left(x, length(x) - 1) END
  WHEN xs LIKE '%vc%' AND xs NOT LIKE '%vc%vc%' AND {_CLOSED.format(s='xs', w='x')} THEN x || 'e' ELSE x END AS w FROM st3"""
_STEP3 = "SELECT t, CASE WHEN w LIKE '%y' AND left(s, length(s) - 1) LIKE '%v%' THEN left(w, length(w) - 1) || 'i' ELSE w END AS w FROM st4"
_STEP4 = _first_rule("""ational>ate tional>tion enci>ence anci>ance izer>ize bli>ble alli>al entli>ent eli>e ousli>ous
  ization>ize ation>ate ator>ate alism>al iveness>ive fulness>ful ousness>ous aliti>al iviti>ive biliti>ble logi>log""", "%vc%")
_STEP5 = _first_rule("icate>ic ative> alize>al iciti>ic ical>ic ful> ness>", "%vc%")
_STEP6 = _first_rule("""al> ance> ence> er> ic> able> ible> ant> ement> ment> ent> ion> ou> ism> ate> iti> ous>
  ive> ize>""", "%vc%vc%")
_STEP7 = f"""SELECT t, CASE WHEN w LIKE '%e' AND (left(s, length(s) - 1) LIKE '%vc%vc%' OR (left(s, length(s) - 1) LIKE '%vc%'
  AND NOT ({_CLOSED.format(s='left(s, length(s) - 1)', w='left(w, length(w) - 1)')}))) THEN left(w, length(w) - 1) ELSE w END AS w FROM st8"""
_STEM_SQL = f"""
st1 AS ({_shaped(_STEP1)}),
st2 AS (SELECT *, CASE WHEN w LIKE '%eed' THEN 0 WHEN w LIKE '%ed' AND left(s, length(s) - 2) LIKE '%v%' THEN 2
                       WHEN w LIKE '%ing' AND left(s, length(s) - 3) LIKE '%v%' THEN 3 ELSE 0 END AS cut FROM st1),
st3 AS (SELECT t, w, s, cut, left(w, length(w) - cut) AS x, left(s, length(s) - cut) AS xs FROM st2),
st4 AS ({_shaped(_STEP2)}),
st5 AS ({_shaped(_STEP3)}),
st6 AS ({_shaped(f"SELECT t, {_STEP4} AS w FROM st5")}),
st7 AS ({_shaped(f"SELECT t, {_STEP5} AS w FROM st6")}),
st8 AS ({_shaped(f"SELECT t, {_STEP6} AS w FROM st7")}),
st9 AS ({_shaped(_STEP7)}),
stems AS (SELECT t, CASE WHEN length(t) <= 2 THEN t WHEN w LIKE '%ll' AND s LIKE '%vc%vc%' THEN left(w, length(w) - 1) ELSE w END AS stem FROM st9)
"""

_DOC_TERMS_SQL = f"""
doc_raw AS ({_raw_terms_sql('doc_id', 'text', 'documents')})
"""


@register("text_terms", ["C1"], sql=f"""
WITH {_DOC_TERMS_SQL},
raw AS (SELECT DISTINCT term FROM doc_raw),
{_STEM_SQL},
doc_terms AS (SELECT DISTINCT doc_id, stem FROM doc_raw JOIN stems ON t = term),
listed AS (SELECT doc_id, count(*) AS n, string_agg(stem, '|' ORDER BY stem) AS terms FROM doc_terms GROUP BY doc_id)
SELECT doc_id, CASE WHEN text IS NOT NULL THEN CAST(coalesce(n, 0) AS INTEGER) END AS n_terms,
       CASE WHEN text IS NOT NULL THEN md5(coalesce(terms, '')) END AS terms_md5
FROM documents LEFT JOIN listed USING (doc_id)
""")
def text_terms(spark, sf_dir):
    """Analyzer output per document: number of distinct index terms (stemmed) and a
    digest of the sorted term list."""
    docs = se.spread(table(spark, sf_dir, "documents")).select(
        "doc_id", se.analyze("text").alias("terms"))
    return docs.select("doc_id", F.size("terms").alias("n_terms"),
                       F.md5(F.array_join(F.array_sort("terms"), "|")).alias("terms_md5"))


def user_queries(spark, sf_dir):
    """Search requests: the text of every user turn of ``conversations``."""
    conv = table(spark, sf_dir, "conversations")
    return conv.filter(F.col("role") == "user").select("conv_id", "turn", F.col("text").alias("query"))


def _search_sql(query_terms: str, raw: str) -> str:
    """Hits (conv_id, turn, id): ``query_terms`` selects (conv_id, turn, term); ``raw``: unstemmed terms of the queries."""
    return f"""
q AS (SELECT conv_id, turn, text AS query FROM conversations WHERE role = 'user'),
{_DOC_TERMS_SQL},
q_raw AS ({raw}),
raw AS (SELECT DISTINCT term FROM (SELECT term FROM doc_raw UNION ALL SELECT term FROM q_raw)),
{_STEM_SQL},
qt AS ({query_terms}),
dp AS (SELECT DISTINCT stem AS term, CAST(doc_id AS VARCHAR) AS id FROM doc_raw JOIN stems ON t = term),
tp AS (SELECT DISTINCT source AS term, CAST(doc_id AS VARCHAR) AS id FROM documents
       WHERE source IS NOT NULL),
hits AS (SELECT DISTINCT conv_id, turn, id FROM (
           SELECT conv_id, turn, id FROM qt JOIN dp USING (term)
           UNION ALL
           SELECT conv_id, turn, id FROM qt JOIN tp USING (term)))
"""


# Query pieces as they are, and queries through the analyzer.
_SEARCH_SQL = _search_sql(f"""SELECT DISTINCT conv_id, turn, term FROM
         (SELECT conv_id, turn, unnest(regexp_extract_all(query, '{se.PIECE_PATTERN}')) AS term FROM q)
       WHERE term <> ''""", "SELECT '' AS term WHERE false")
_ANALYZED_SQL = _search_sql("SELECT DISTINCT conv_id, turn, stem AS term FROM q_raw JOIN stems ON t = term",
                            _raw_terms_sql("conv_id, turn", "query", "q"))
_FIRST_PAGE_SQL = f"""
r AS (SELECT *, row_number() OVER (PARTITION BY conv_id, turn ORDER BY id) AS rank,
             count(*) OVER (PARTITION BY conv_id, turn) AS total FROM hits)
SELECT conv_id, turn, any_value(total) AS total, CAST(count(*) AS INTEGER) AS size,
       string_agg(id, '|' ORDER BY rank) AS ids
FROM r WHERE rank <= {se.DEFAULT_PAGE_SIZE} GROUP BY conv_id, turn
"""


def _query_terms(spark, sf_dir, analyze_query: bool = False):
    q = user_queries(spark, sf_dir)
    if analyze_query:
        return q.select("conv_id", "turn", F.explode(se.analyze("query")).alias("term")).distinct()
    return se.query_terms(q, ["conv_id", "turn"])


def _index(spark, sf_dir, q_terms):
    """The stored index of the terms that some query uses (posting lists kept whole: exact)."""
    items = bindings.described_items(spark, sf_dir)
    return stored(se.item_index(items, se.DEFAULT_PAGE_SIZE, pairs=se.uses_pairs(q_terms), used=q_terms), "term-index")


def _first_page(q_terms, index):
    keys = ["conv_id", "turn"]
    res = se.search_results(q_terms, keys, index, page=0, size=se.DEFAULT_PAGE_SIZE)
    return res.select(*keys, "total", F.size("ids").alias("size"),
                      F.array_join("ids", "|").alias("ids"))


def search_hits(spark, sf_dir, analyze_query: bool = False):
    """The full hit set (query, item) - for callers that need every hit."""
    items = bindings.described_items(spark, sf_dir)
    analyzed = items.select("id", F.explode(se.analyze("description")).alias("term"))
    return se.search_hits(_query_terms(spark, sf_dir, analyze_query), ["conv_id", "turn"],
                          analyzed, se.tag_postings(items))


@register("search_first_page", ["F7", "J8", "C2", "T1", "A8", "A13", "C10"], bench=True,
          sql=f"WITH {_SEARCH_SQL},{_FIRST_PAGE_SQL}")
def search_first_page(spark, sf_dir):
    """Every user turn run as a catalog search over item descriptions and
    tags: hit total and the first page (20 items by id); no hits = no row.
    Query pieces meet the stemmed index as they are.  Totals come from united
    posting lists and the page from each term's first 20 items, so no
    (query, item) pair set is built."""
    qt = stored(_query_terms(spark, sf_dir), "query-terms")
    return _first_page(qt, _index(spark, sf_dir, qt))


@register("search_analyzed_first_page", ["C1", "F7", "J8", "T1", "A8"],
          sql=f"WITH {_ANALYZED_SQL},{_FIRST_PAGE_SQL}")
def search_analyzed_first_page(spark, sf_dir):
    """The same searches with analyzed queries: a query's stemmed words and word
    pairs meet the stemmed index, so that other forms of a word are found."""
    qt = stored(_query_terms(spark, sf_dir, analyze_query=True), "query-terms")
    return _first_page(qt, _index(spark, sf_dir, qt))


_CATEGORY_SQL = f"""
WITH {HARVEST_SQL},
members AS (SELECT DISTINCT unnest(categories) AS category, id, doc.title AS title FROM merged),
r AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY id) AS rank,
             count(*) OVER (PARTITION BY category) AS total FROM members)
"""


def category_listing(spark, sf_dir):
    snap = catalog_snapshot(spark, sf_dir)
    members = se.category_members(snap, keep=("title",))
    return se.with_page(se.ranked(members, ["category"]), se.WEB_PAGE_SIZE)


@register("category_pages", ["F6", "T1", "A8", "A13"], bench=True, sql=f"""
{_CATEGORY_SQL}
SELECT category, CAST((rank - 1) // {se.WEB_PAGE_SIZE} AS INTEGER) AS page,
       CAST(count(*) AS INTEGER) AS size,
       any_value(total) AS total, string_agg(id, '|' ORDER BY rank) AS ids,
       md5(string_agg(title, '|' ORDER BY rank)) AS titles_md5
FROM r GROUP BY 1, 2
""")
def category_pages(spark, sf_dir):
    """Every page (30 items, by id as a string) of every category of the
    merged catalog, with the category's total."""
    listing = category_listing(spark, sf_dir)
    docs = se.page_documents(listing, ["category"], ["id", "title"],
                             se.totals(listing, ["category"]))
    return docs.select("category", "page", "size", "total",
                       F.array_join(F.transform("items", lambda x: x["id"]), "|").alias("ids"),
                       F.md5(F.array_join(F.transform("items", lambda x: x["title"]), "|"))
                       .alias("titles_md5"))


@register("category_page_directory", ["T7", "A8"], sql=f"""
WITH {HARVEST_SQL},
members AS (SELECT DISTINCT unnest(categories) AS category, id FROM merged),
t AS (SELECT category, count(*) AS total FROM members GROUP BY 1),
d AS (SELECT category, total, CAST(trunc(total / {se.WEB_PAGE_SIZE}) AS INTEGER) AS last FROM t)
SELECT category, total, last + 1 AS pages, CAST(page AS INTEGER) AS page, page > 0 AS has_prev,
       page < last AS has_next, CAST(greatest(page - 1, 0) AS INTEGER) AS prev_page,
       CAST(page + 1 AS INTEGER) AS next_page
FROM d, LATERAL (SELECT unnest(range(0, last + 1)) AS page) p
""")
def category_page_directory(spark, sf_dir):
    """Page directory of every category (previous / next links and page
    count, with the front end's one-page-too-many on exact multiples)."""
    snap = catalog_snapshot(spark, sf_dir)
    total = se.totals(se.category_members(snap), ["category"])
    return se.page_directory(total, se.WEB_PAGE_SIZE, compat=True).select(
        "category", "total", "pages", "page", "has_prev", "has_next", "prev_page", "next_page")


@register("item_lookup", ["F5", "J1"], sql="""
WITH wanted AS (SELECT DISTINCT json_extract_string(props, '$.k') AS id FROM events
                WHERE json_extract_string(props, '$.k') IS NOT NULL)
SELECT w.id, p.p_partkey IS NOT NULL AS found, p.p_name AS title
FROM wanted w LEFT JOIN part p ON CAST(p.p_partkey AS VARCHAR) = w.id
""")
def item_lookup(spark, sf_dir):
    """Point lookup of every item id the click events ask for; ids without
    a catalog document come back as not found."""
    wanted = (bindings.click_events(spark, sf_dir).select(F.col("item").alias("id"))
              .filter(F.col("id").isNotNull()).distinct())
    items = bindings.catalog_items(spark, sf_dir).select("id", "title")
    return se.lookup(items, wanted).select("id", "found", "title")


_PREFIX_SQL = f"""
q AS (SELECT DISTINCT unnest(regexp_extract_all({_fold_sql('text')}, '{se.TOKEN_PATTERN}')) AS prefix
      FROM conversations WHERE role = 'user'),
q2 AS (SELECT prefix, length(prefix) AS m, substr(prefix, 2) AS w,
              CASE WHEN length(prefix) < 3 THEN 0 WHEN length(prefix) <= 5 THEN 1 ELSE 2 END AS d
       FROM q),
t AS (SELECT DISTINCT p_name AS title, {_fold_sql('p_name')} AS ft FROM part WHERE p_name IS NOT NULL),
heads AS (SELECT DISTINCT prefix, m, w, d, substr(ft, 2, m - 1 + d) AS h
          FROM q2 JOIN t ON substr(ft, 1, 1) = substr(prefix, 1, 1)),
-- The table of distances, a row of it per character of the title: beginnings of w against the first i characters of h.
dp AS (
  SELECT prefix, m, w, d, h, CAST(0 AS BIGINT) AS i, [CAST(0 AS BIGINT)] AS before, range(0, length(w) + 1) AS now FROM heads
  UNION ALL
  SELECT prefix, m, w, d, h, i + 1, now, list_reduce(
    list_concat([[i + 1]], list_transform(range(1, length(w) + 1), lambda j: [j])),
    lambda a, x: list_append(a, least(now[x[1] + 1] + 1, a[len(a)] + 1,
      now[x[1]] + CASE WHEN substr(h, i + 1, 1) = substr(w, x[1], 1) THEN 0 ELSE 1 END,
      CASE WHEN i > 0 AND x[1] > 1 AND substr(h, i + 1, 1) = substr(w, x[1] - 1, 1) AND substr(h, i, 1) = substr(w, x[1], 1)
           THEN before[x[1] - 1] + 1 ELSE 1000 END)))
  FROM dp WHERE i < length(h)),
scored AS (SELECT prefix, h, m, d, min(now[len(now)]) AS distance FROM dp WHERE i >= m - 1 - d GROUP BY ALL),
pairs AS (
  SELECT prefix, title, distance, d FROM scored JOIN t
  ON substr(ft, 1, 1) = substr(prefix, 1, 1) AND substr(ft, 2, m - 1 + d) = h)
"""


def typed_prefixes(spark, sf_dir):
    """What shoppers type into the search box: every word of every user
    turn of ``conversations``."""
    conv = table(spark, sf_dir, "conversations").filter(F.col("role") == "user")
    return conv.select(F.explode(se.tokens("text")).alias("prefix"))


@register("suggest_titles", ["T9", "C3"], bench=True, sql=f"""
WITH RECURSIVE {_PREFIX_SQL},
r AS (SELECT prefix, title, distance,
             row_number() OVER (PARTITION BY prefix ORDER BY distance, title) AS rank
      FROM pairs WHERE distance <= d)
SELECT prefix, CAST(rank AS INTEGER) AS rank, title, CAST(distance AS INTEGER) AS distance
FROM r WHERE rank <= {se.SUGGESTIONS}
""")
def suggest_titles(spark, sf_dir):
    """Top 10 title suggestions per typed word (fuzzy prefix match, first
    letter exact, ranked by edit distance then title)."""
    titles = bindings.catalog_items(spark, sf_dir).select("title")
    return se.suggest(titles, typed_prefixes(spark, sf_dir))


@register("search_first_page_indexed", ["J8", "F7", "A8", "T1"], sql=f"WITH {_SEARCH_SQL},{_FIRST_PAGE_SQL}")
def search_first_page_indexed(spark, sf_dir):
    """The same searches served from a term index written once to the
    shared folder (partitioned by term hash) and read back pruned to the
    query terms - the serving path for many query batches."""
    path = scratch(spark, "term-index")
    se.store_index(se.item_index(bindings.described_items(spark, sf_dir), se.DEFAULT_PAGE_SIZE), path)
    qt = stored(_query_terms(spark, sf_dir), "query-terms")
    return _first_page(qt, stored(se.read_index(spark, path, qt), "used-index"))
