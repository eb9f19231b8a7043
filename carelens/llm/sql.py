"""DuckDB statements for the operators that SQL can express."""

_BLANKS = r"[\x20\x09-\x0D]+"

LINE_RULES = rf"""
WITH base AS (
  SELECT doc_id, coalesce(text, '') AS t,
         list_filter(string_split_regex(coalesce(text, ''), '{_BLANKS}'), lambda w: w <> '') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS ls
  FROM documents),
grams AS (
  SELECT doc_id, i, concat_ws(' ', w[i], w[i+1], w[i+2], w[i+3], w[i+4]) AS g
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM base WHERE len(w) >= 5)),
twice AS (SELECT doc_id, g FROM grams GROUP BY 1, 2 HAVING count(*) > 1),
repeated AS (
  SELECT doc_id, count(DISTINCT i + j) AS n
  FROM grams JOIN twice USING (doc_id, g), range(5) AS o(j) GROUP BY 1),
lines AS (
  SELECT doc_id, l, list_filter(string_split_regex(l, '{_BLANKS}'), lambda w: w <> '') AS lw,
         regexp_replace(regexp_replace(l, '^{_BLANKS}', ''), '{_BLANKS}$', '') AS bare
  FROM (SELECT doc_id, unnest(ls) AS l FROM base)),
judged AS (
  SELECT doc_id, len(lw) AS n,
         regexp_matches(bare, '[.!?…。！？؟।](\s|["''”’)\]]|$)')
         AND NOT len(regexp_replace(l, '[^|<>]', '', 'g')) > 0.1 * len(lw)
         AND NOT len(regexp_replace(l, '[^#*$%&|<>]', '', 'g')) > 0.1 * len(lw)
         AND NOT (len(lw) >= 3 AND upper(bare) = bare AND lower(bare) <> bare)
         AND NOT (len(lw) >= 20 AND len(list_distinct(lw)) < 0.2 * len(lw))
         AND NOT regexp_matches(lower(bare), 'cookie|privacy policy|terms of use|terms of service|all rights reserved|javascript|lorem ipsum|click here|sign up|log in|subscribe to|copyright ©|licensed under|permission is hereby granted|without warranty') AS ok
  FROM lines),
kept AS (SELECT doc_id, count(*) AS n_lines, count(*) FILTER (ok) AS n_ok,
                coalesce(sum(n) FILTER (ok), 0) AS n_kept FROM judged GROUP BY 1),
counted AS (
  SELECT b.doc_id, len(w) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: len(x))), 0) AS BIGINT) AS word_chars,
         CAST(len(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, CAST(coalesce(r.n, 0) AS BIGINT) AS n_repeat_words,
         CAST(coalesce(k.n_lines, 0) AS BIGINT) AS n_lines, CAST(coalesce(n_ok, 0) AS BIGINT) AS n_ok,
         CAST(coalesce(n_kept, 0) AS BIGINT) AS n_kept
  FROM base b LEFT JOIN repeated r USING (doc_id) LEFT JOIN kept k USING (doc_id)),
failed AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM counted)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND n_kept >= 0.5 * n_words AS kept,
       n_lines, n_lines - n_ok AS n_lines_removed, n_words - n_kept AS n_words_removed
FROM failed
"""


def _share(level: int) -> str:
    """One level of the budget: water-filling of each parent's budget over its children."""
    tree = ("domain", "lang", "source")
    keys, parent = ", ".join(tree[:level + 1]), ", ".join(tree[:level])
    by = f"PARTITION BY {parent}" if parent else ""
    weight = ("CASE domain WHEN 'd0' THEN 400 WHEN 'd1' THEN 300 WHEN 'd2' THEN 200 WHEN 'd3' THEN 100 ELSE 100 END",
              "CASE lang WHEN 'en' THEN 500 WHEN 'de' THEN 200 WHEN 'fr' THEN 200 ELSE 100 END", "100")[level]
    up = f"JOIN got{level - 1} USING ({parent})" if level else ""
    budget = f"got{level - 1}.got" if level else "(SELECT CAST(floor(sum(n_tokens) * 0.5) AS BIGINT) FROM meta)"
    return f"""
node{level} AS (SELECT {keys}, cap, {budget} AS budget, {weight} AS w
  FROM (SELECT {keys}, CAST(sum(tokens) * 2 AS BIGINT) AS cap FROM leaves GROUP BY {keys}) {up}),
ranked{level} AS (SELECT *, sum(cap) OVER o - cap AS before,
    sum(w) OVER ({by} ORDER BY cap / w, {tree[level]} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest
  FROM node{level} WHERE cap > 0
  WINDOW o AS ({by} ORDER BY cap / w, {tree[level]} ROWS UNBOUNDED PRECEDING)),
judged{level} AS (SELECT *, CAST(cap AS DOUBLE) * rest <= CAST(w AS DOUBLE) * (budget - before) AS is_full FROM ranked{level}),
open{level} AS (SELECT *, CAST(budget - sum(CASE WHEN is_full THEN cap ELSE 0 END) OVER ({by}) AS DOUBLE) AS remaining,
    sum(CASE WHEN is_full THEN 0 ELSE w END) OVER ({by}) AS all_w,
    sum(CASE WHEN is_full THEN 0 ELSE w END) OVER ({by} ORDER BY cap / w, {tree[level]} ROWS UNBOUNDED PRECEDING) AS upto
  FROM judged{level}),
got{level} AS (SELECT {keys}, CAST(CASE WHEN is_full THEN cap
    ELSE floor(remaining * upto / all_w) - floor(remaining * (upto - w) / all_w) END AS BIGINT) AS got FROM open{level})"""


MIX_SOURCES = rf"""
WITH meta AS (
  SELECT doc_id, coalesce('d' || CAST(CAST(regexp_extract(source, '([0-9]+)$', 1) AS INT) % 4 AS VARCHAR), 'none') AS domain,
         coalesce(lang, 'none') AS lang, coalesce(source, 'none') AS source,
         CAST(len(list_filter(string_split_regex(text, '{_BLANKS}'), lambda w: w <> '')) AS BIGINT) AS n_tokens
  FROM documents WHERE regexp_matches(text, '[^\x20\x09-\x0D]')),
leaves AS (SELECT domain, lang, source, sum(n_tokens) AS tokens FROM meta GROUP BY 1, 2, 3),
{_share(0)},{_share(1)},{_share(2)},
quota AS (SELECT l.*, e AS epoch, least(tokens, got - e * tokens) AS quota
  FROM leaves l JOIN got2 USING (domain, lang, source), range(2) AS r(e)),
placed AS (SELECT m.*, q.epoch, q.quota, sum(n_tokens) OVER (
    PARTITION BY domain, lang, source, q.epoch ORDER BY md5('20:' || q.epoch || ':' || doc_id) ROWS UNBOUNDED PRECEDING) - n_tokens AS start
  FROM meta m JOIN quota q USING (domain, lang, source) WHERE q.quota > 0)
SELECT doc_id, CAST(epoch AS INT) AS epoch, domain, lang, source, n_tokens,
       CAST(least(n_tokens, quota - start) AS BIGINT) AS taken
FROM placed WHERE start < quota
"""


WARC_INDEX = r"""
WITH page AS (
  SELECT page_id, coalesce(html, '') AS body, lower(coalesce(url, '')) AS u FROM pages),
held AS (
  SELECT page_id, u, octet_length(encode(body)) AS payload_bytes, sha1(body) AS hex, min(page_id) OVER (PARTITION BY body) AS low FROM page),
keyed AS (
  SELECT *, regexp_extract(u, '^[a-z]+://(?:www[0-9]*\.)?([^/:?#]*)', 1) AS host,
         regexp_extract(u, '^[a-z]+://[^/?#]*([^?#]*)', 1) AS path, regexp_extract(u, '^[^?#]*\?([^#]*)', 1) AS args FROM held),
named AS (
  SELECT page_id, payload_bytes, low,
         list_aggregate(list_transform(range(8), lambda i: list_aggregate(list_transform(range(4), lambda j:
           substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
                  1 + CAST((CAST('0x' || substr(hex, CAST(1 + 5 * i AS INT), 5) AS INT) // CAST(pow(32, 3 - j) AS INT)) % 32 AS INT), 1)), 'string_agg', '')), 'string_agg', '')
           AS payload_digest,
         CASE WHEN u = '' THEN '' ELSE list_aggregate(list_reverse(string_split(host, '.')), 'string_agg', ',') || ')' || CASE WHEN path = '' THEN '/' ELSE path END
           || CASE WHEN args = '' THEN '' ELSE '?' || list_aggregate(list_sort(string_split(args, '&')), 'string_agg', '&') END END AS url_key,
         strftime(TIMESTAMP '2020-01-01' + to_seconds(page_id), '%Y%m%d%H%M%S') AS stamp
  FROM keyed)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = low THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = low THEN NULL ELSE low END AS refers_to, url_key, stamp,
       row_number() OVER (ORDER BY url_key, stamp, page_id) AS rank, true AS valid
FROM named
"""


def _merkle(up: int = 8, over: int = 3) -> str:
    """Every level as a statement of its own: ``up`` levels above the leaves, ``over`` above the subroots."""
    out = []

    def level(name: str, below: str) -> None:
        # a group of one node is its own top and stays; the others are hashed by eights
        out.append(f"""{name} AS MATERIALIZED (SELECT g, i // 8 AS i, CASE WHEN any_value(n) > 1 THEN sha256(string_agg(h, '' ORDER BY i)) ELSE any_value(h) END AS h,
  CAST(ceil(any_value(n) / 8.0) AS BIGINT) AS n FROM {below} GROUP BY g, i // 8)""")

    def fold(name: str, below: str, nodes: str, at: str) -> None:
        # l and r: the others of the node's run, on its left and on its right
        out.append(f"""{name} AS MATERIALIZED (SELECT v.* REPLACE (CASE WHEN s.n > 1 THEN sha256(coalesce(l, '') || folded || coalesce(r, '')) ELSE folded END AS folded,
    CASE WHEN s.n > 1 THEN others || coalesce(l, '') || coalesce(r, '') ELSE others END AS others, v.{at} // 8 AS {at})
  FROM {below} v JOIN (SELECT g, i, n, string_agg(h, '') OVER (PARTITION BY g, i // 8 ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS l,
      string_agg(h, '') OVER (PARTITION BY g, i // 8 ORDER BY i ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS r FROM {nodes}) s
    ON s.i = v.{at} AND s.g = {'v.g' if at == 'i' else "''"})""")

    for k in range(1, up + 1):
        level(f"node{k}", f"node{k - 1}")
    out.append(f"""over0 AS MATERIALIZED (SELECT '' AS g, g AS own, row_number() OVER (ORDER BY g) - 1 AS i, h, count(*) OVER () AS n FROM node{up})""")
    for k in range(1, over + 1):
        level(f"over{k}", f"over{k - 1}")
    out.append("""way0 AS MATERIALIZED (SELECT leaf.*, over0.i AS j, over0.h AS subroot, '' AS others, coalesce(changed, leaf.h) AS folded
  FROM (SELECT doc_id, g, i, h, changed FROM node0) leaf JOIN (SELECT own, i, h FROM over0) over0 ON over0.own = leaf.g)""")
    for k in range(up):
        fold(f"way{k + 1}", f"way{k}", f"node{k}", "i")
    for k in range(over):
        fold(f"way{up + k + 1}", f"way{up + k}", f"over{k}", "j")
    field = lambda c: f"coalesce(CAST(octet_length(encode(CAST({c} AS VARCHAR))) AS VARCHAR) || ':' || CAST({c} AS VARCHAR), '-')"
    head = " || ".join(field(c) for c in ("doc_id", "source", "lang", "n_chars"))
    low = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"""
WITH crc AS (
  SELECT list(t ORDER BY b) AS t FROM (
    SELECT b, list_reduce(range(8), lambda c, _: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, CAST(b AS BIGINT)) AS t
    FROM range(256) AS r(b))),
hashed AS (
  SELECT doc_id, CASE WHEN lang IS NULL THEN '0' ELSE '1' || lang END AS g, sha256({head} || {field('text')}) AS h,
         CASE WHEN xor(list_reduce(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ord(x) AS BIGINT)),
                lambda c, x: xor(c >> 8, t[xor(c & 255, x) + 1]), 4294967295), 4294967295) % 3 = 0
              THEN sha256({head} || {field(low)}) END AS changed
  FROM documents, crc),
node0 AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id) - 1 AS i, count(*) OVER (PARTITION BY g) AS n FROM hashed),
{", ".join(out)}
SELECT doc_id, h AS leaf, subroot, (SELECT h FROM over{over}) AS root, sha256(others) AS proof_sha256, folded AS folded_root,
       folded = (SELECT h FROM over{over}) AS verified
FROM way{up + over}
"""


MERKLE_MANIFEST = _merkle()
