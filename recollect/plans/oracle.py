"""SQL that gives the rows of the registered queries, written apart from them."""

from __future__ import annotations

from recollect.functions import rules as R
from recollect.plans import queries as Q

DAY0 = "TIMESTAMP '2024-01-01'"
NOW = "TIMESTAMP '2024-02-01'"


def status(s: str) -> str:
    return f"CASE WHEN {s} > 0.5 THEN 'active' WHEN {s} > 0.3 THEN 'fading' WHEN {s} > 0.1 THEN 'dormant' ELSE 'retired' END"


MEM = f"""mem AS (SELECT *, CASE WHEN id % 17 = 0 THEN 'locked' WHEN id % 11 = 0 THEN 'candidate' ELSE {status('strength')} END AS status,
  least(1.0, strength + least(0.2, 0.05 * ln(1 + frequency)) + least(0.15, 0.04 * ln(1 + turns))) AS act,
  greatest(0, epoch_us({NOW}) - epoch_us(learned_at)) / CAST(8.64e10 AS DOUBLE) AS days FROM (
  SELECT d.doc_id AS id, CASE WHEN doc_id % 20 = 0 THEN 'mental_model' WHEN doc_id % 20 <= 3 THEN 'observation' WHEN doc_id % 20 <= 18 THEN 'raw' ELSE 'experience' END AS layer,
  text AS statement, text, CASE WHEN source IN ('src0', 'src1') THEN 'global' ELSE 'project:' || source END AS scope, lang AS domain, [source, lang] AS tags,
  {DAY0} + to_seconds(doc_id * 7919 % 2592000) AS learned_at, CAST(0.1 AS DOUBLE) + (doc_id * 37 % 90) / CAST(100 AS DOUBLE) AS strength,
  CAST(0.2 AS DOUBLE) + (doc_id * 53 % 80) / CAST(100 AS DOUBLE) AS storage, doc_id % 23 AS frequency, doc_id % 13 AS turns, 1 + doc_id % 10 AS weight, 1 + doc_id * 3 % 10 AS confidence,
  CASE doc_id % 3 WHEN 0 THEN 'do' WHEN 1 THEN 'dont' END AS polarity, doc_id % 4 = 0 AS consolidated, coalesce(l.quality, 0) AS positive, coalesce(l.toxic, 0) AS negative,
  doc_id % 7 AS adopted, 1 + doc_id % 6 AS proof, doc_id % 4 AS evidence, doc_id % 5 AS sources, CASE WHEN doc_id % 8 <> 0 THEN {DAY0} + to_seconds(doc_id * 7919 % 2592000) + to_seconds(doc_id % 31 * 79200) END AS last_accessed, CASE doc_id % 2 WHEN 0 THEN 'new' ELSE 'stable' END AS trend,
  {DAY0} + to_seconds(doc_id * 7919 % 2592000) + to_seconds((doc_id % 5 - 1) * 3600) AS valid_from, CASE WHEN doc_id % 3 <> 0 THEN {DAY0} + to_seconds(doc_id * 7919 % 2592000) + to_seconds(doc_id % 9 * 86400) END AS last_seen FROM documents d LEFT JOIN labels l USING (doc_id)))"""
#: The same with statements that fit a token budget.
SHORT = MEM.replace("text AS statement", "substr(text, 1, 160) AS statement")
CHARS = "[\\x{4e00}-\\x{9fff}]"


def grams(t: str, n: int) -> str:
    return f"list_filter(list_transform(range(1, CAST(length({t}) AS BIGINT) - {n - 2}), lambda i: substr({t}, i, {n})), lambda g: regexp_full_match(g, '{CHARS}{{{n}}}'))"


def tokens(t: str) -> str:
    return f"list_concat(regexp_extract_all(lower({t}), '[a-z0-9]+'), list_concat({grams(t, 3)}, {grams(t, 2)}))"


WORDS = "regexp_extract_all(lower(text), '[a-z0-9]+')"  # the tables' texts hold no CJK
PAIRS = "pairs AS (SELECT conv_id, turn, text AS \"user\", nt AS assistant FROM (SELECT *, lead(role) OVER w AS nr, lead(text) OVER w AS nt FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) WHERE role = 'user' AND nr = 'assistant')"


def values(rows: list[tuple], names: str) -> str:
    lit = lambda v: "'" + v.replace("'", "''") + "'" if isinstance(v, str) else str(v)
    return f"(VALUES {', '.join('(' + ', '.join(map(lit, r)) + ')' for r in rows)}) AS t({names})"


def asked(*texts: str) -> str:
    return f"q AS (SELECT CAST(query_id AS BIGINT) AS query_id, query FROM {values([(i + 1, t) for i, t in enumerate(texts)], 'query_id, query')})"


def token_set(t: str) -> str:
    return f"list_distinct(list_filter(regexp_split_to_array(lower({t}), '[\\s,.;:!?，。；：！？、()（）\\[\\]{{}}<>《》\"'']+'), lambda w: length(w) >= 2))"


def bm25(source: str, k: int = 30) -> str:
    """CTEs ending in bm25(query_id, id, score, rank) over q(query_id, query) and `source`(id, text)."""
    return f"""tk AS (SELECT id, {WORDS} AS ts FROM {source}), n AS (SELECT count(*) AS n, avg(len(ts)) AS avgdl FROM tk),
x AS (SELECT id, len(ts) AS dl, unnest(ts) AS token FROM tk), tf AS (SELECT id, dl, token, count(*) AS tf FROM x GROUP BY ALL), df AS (SELECT token, count(*) AS df FROM tf GROUP BY token),
qt AS (SELECT query_id, token, count(*) AS times FROM (SELECT query_id, unnest(regexp_extract_all(lower(query), '[a-z0-9]+')) AS token FROM q) GROUP BY ALL),
bs AS (SELECT query_id, id, round(sum(times * ln((n - df + CAST(0.5 AS DOUBLE)) / (df + CAST(0.5 AS DOUBLE)) + 1) * tf * CAST(2.2 AS DOUBLE) / (tf + CAST(1.2 AS DOUBLE) * (CAST(0.25 AS DOUBLE) + CAST(0.75 AS DOUBLE) * dl / avgdl))), 6) AS score FROM tf JOIN df USING (token) JOIN qt USING (token), n GROUP BY query_id, id),
bm25 AS (SELECT * FROM (SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM bs WHERE score > 0) WHERE rank <= {k})"""


EDGES = """ed AS (SELECT * FROM (SELECT doc_id AS src, doc_id // 2 AS dst, CASE doc_id % 3 WHEN 0 THEN 'semantic' WHEN 1 THEN 'causal' ELSE 'co_accessed' END AS type, CAST(0.5 AS DOUBLE) + doc_id % 5 / CAST(10 AS DOUBLE) AS weight FROM documents
UNION ALL SELECT doc_id, doc_id + 1 + doc_id * 13 % 17, 'temporal', CAST(0.4 AS DOUBLE) + doc_id % 6 / CAST(10 AS DOUBLE) FROM documents) WHERE src <> dst)"""
BRIDGE = "br AS (SELECT DISTINCT l_orderkey AS memory_id, l_partkey AS entity FROM lineitem)"
SEEDS = "seeds AS (SELECT * FROM (VALUES (1::BIGINT, 3::BIGINT, 1.0::DOUBLE, 1), (1, 5, 0.9, 2), (2, 40, 0.8, 1)) AS t(query_id, id, score, rank))"


def graph(seeds: str, k: int = 30) -> str:
    return f"""own AS (SELECT s.query_id, s.id AS seed, b.entity FROM {seeds} s JOIN br b ON b.memory_id = s.id),
sh AS (SELECT query_id, seed, memory_id AS id, count(*) AS shared FROM own JOIN br USING (entity) WHERE memory_id <> seed GROUP BY ALL),
lk AS (SELECT s.query_id, s.id AS seed, e.dst AS id, type, weight FROM {seeds} s JOIN ed e ON e.src = s.id UNION ALL SELECT s.query_id, s.id, e.src, type, weight FROM {seeds} s JOIN ed e ON e.dst = s.id),
gs AS (SELECT query_id, id, round(sum(w), 6) AS score FROM (SELECT query_id, id, tanh(shared * CAST(0.5 AS DOUBLE)) AS w FROM sh UNION ALL SELECT query_id, id, CASE type WHEN 'semantic' THEN weight WHEN 'causal' THEN weight + 1 WHEN 'co_accessed' THEN weight * CAST(0.8 AS DOUBLE) END FROM lk WHERE type <> 'temporal') GROUP BY ALL),
graph AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM gs) WHERE rank <= {k})"""


def bfs(seeds: str, ord_: str) -> str:
    """CTEs ending in reach(query_id, id, score, round): three rounds, the first to come stays."""
    out = [f"r0 AS (SELECT query_id, id, score, CAST(rank AS BIGINT) AS a, 0 AS round FROM {seeds})"]
    seen = "SELECT query_id, id, score, round FROM r0"
    for i in (1, 2, 3):
        out.append(f"p{i} AS (SELECT r.query_id, e.dst AS id, round(r.score * e.weight * CAST(0.7 AS DOUBLE), 6) AS score, r.a, {ord_} AS ord FROM r{i - 1} r JOIN ed e ON e.src = r.id WHERE e.type IN ('temporal', 'causal')), s{i} AS ({seen})")
        out.append(f"f{i} AS (SELECT query_id, id, score, a, ord, row_number() OVER (PARTITION BY query_id, id ORDER BY a, ord) AS k FROM p{i} WHERE score >= 0.1 AND (query_id, id) NOT IN (SELECT (query_id, id) FROM s{i}))")
        out.append(f"r{i} AS (SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY a, ord) AS a, {i} AS round FROM f{i} WHERE k = 1)")
        seen += f" UNION ALL SELECT query_id, id, score, round FROM r{i}"
    return ", ".join(out) + f", reach AS ({seen})"


LISTS = f"""{asked(*Q.MANY)}, dx AS (SELECT doc_id AS id, text FROM documents), {bm25('dx')},
near AS (SELECT * FROM (SELECT query_id, id, round(exp(-days / 30), 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(exp(-days / 30), 6) DESC, id) AS rank FROM mem, (VALUES (1::BIGINT), (2)) AS t(query_id) WHERE status <> 'retired') WHERE rank <= 30)"""


def fuse(*lists: str, k: int | None = None) -> str:
    both = " UNION ALL ".join(f"SELECT query_id, id, rank, {i} AS list FROM {x}" for i, x in enumerate(lists))
    return f"""fs AS (SELECT query_id, id, round(sum(CAST(1 AS DOUBLE) / (60 + rank)), 9) AS score, min((list, rank)) AS came FROM ({both}) GROUP BY ALL),
fused AS (SELECT * FROM (SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, came) AS rank FROM fs){f' WHERE rank <= {k}' if k else ''})"""


def dims(relevance: str, scope: str) -> dict[str, str]:
    return {
        "relevance": f"least(1.0, {relevance})",
        "specificity": "least(1.0, ln(1 + length(statement)) / ln(201))",
        "activation": "least(1.0, act)",
        "recency": "exp(-days / 30)",
        "evidence": "least(1.0, least(0.5, CAST(0.1 AS DOUBLE) * proof) + least(0.3, CAST(0.1 AS DOUBLE) * evidence) + least(0.2, CAST(0.05 AS DOUBLE) * sources))",
        "confidence": "confidence / CAST(10 AS DOUBLE)",
        "scope": scope,
        "polarity": "CASE polarity WHEN 'do' THEN CAST(0.8 AS DOUBLE) WHEN 'dont' THEN CAST(0.6 AS DOUBLE) ELSE CAST(0.5 AS DOUBLE) END",
        "quality": QUALITY,
    }


QUALITY = """least(1.0, least(0.30, CAST(0.08 AS DOUBLE) * ln(1 + turns)) + CAST(0.30 AS DOUBLE) * least(1.0, act) + CASE WHEN consolidated THEN CAST(0.15 AS DOUBLE) ELSE 0 END
 + CAST(0.15 AS DOUBLE) * CASE WHEN positive + negative > 0 THEN positive / CAST(positive + negative AS DOUBLE) ELSE 0 END + least(0.20, CAST(0.06 AS DOUBLE) * ln(1 + adopted)))"""


def total(d: dict[str, str]) -> str:
    return "round(" + " + ".join(f"CAST({R.RANK_WEIGHTS[k]} AS DOUBLE) * ({v})" for k, v in d.items()) + ", 6)"


ACTIVATED = "av AS (SELECT f.query_id, f.score AS rrf, m.*, round(CAST(0.7 AS DOUBLE) * f.score + CAST(0.3 AS DOUBLE) * m.act, 6) AS relevance FROM fused f JOIN mem m USING (id) WHERE m.status <> 'retired')"
RERANKED = f"rk AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM (SELECT *, {total(dims('relevance', 'CAST(0.5 AS DOUBLE)'))} AS score FROM av))"


def trim(budget: int) -> str:
    share = "CASE layer " + " ".join(f"WHEN '{k}' THEN {int(budget * v)}" for k, v in R.BUDGET_SHARES.items()) + " END"
    cost = "CAST(ceil(length(statement) / CAST(4 AS DOUBLE)) AS BIGINT)"
    return f"""it AS (SELECT query_id, layer, id, {cost} AS cost, {share} AS share, row_number() OVER (PARTITION BY query_id, layer ORDER BY rank) AS i FROM rk),
tr(query_id, layer, i, id, used, took) AS (SELECT query_id, layer, i, id, CASE WHEN cost <= share THEN cost ELSE 0 END, cost <= share FROM it WHERE i = 1
UNION ALL SELECT t.query_id, t.layer, n.i, n.id, CASE WHEN t.used + n.cost <= n.share THEN t.used + n.cost ELSE t.used END, t.used + n.cost <= n.share FROM tr t JOIN it n ON n.query_id = t.query_id AND n.layer = t.layer AND n.i = t.i + 1),
kept AS (SELECT rk.* FROM rk JOIN tr USING (query_id, layer, id) WHERE took)"""


#: Full-text search of memories, for queries without operators, then BM25 where it finds nothing.
LEXICAL = """fm AS (SELECT query_id, unnest(list_distinct(list_filter(string_split(query, ' '), lambda t: length(t) >= 3))) AS term FROM q WHERE NOT contains(query, '-')),
fd AS (SELECT id, lower(concat_ws(chr(10), CAST(id AS VARCHAR), text, scope, domain, array_to_string(tags, ' '))) AS t, greatest(0, length(CAST(id AS VARCHAR)) - 2) + greatest(0, length(text) - 2) + greatest(0, length(scope) - 2) + greatest(0, length(domain) - 2) + greatest(0, length(array_to_string(tags, ' ')) - 2) AS len FROM mem),
fh AS (SELECT id, len, term, (length(t) - length(replace(t, term, ''))) / CAST(length(term) AS DOUBLE) AS tf FROM fd, (SELECT DISTINCT term FROM fm) WHERE contains(t, term)), ff AS (SELECT term, count(*) AS df FROM fh GROUP BY term),
fc AS (SELECT query_id, id, round(sum(greatest(ln((fn - df + CAST(0.5 AS DOUBLE)) / (df + CAST(0.5 AS DOUBLE))), CAST(1e-6 AS DOUBLE)) * tf * CAST(2.2 AS DOUBLE) / (tf + CAST(1.2 AS DOUBLE) * (CAST(0.25 AS DOUBLE) + CAST(0.75 AS DOUBLE) * len / al))), 6) AS score FROM fh JOIN ff USING (term) JOIN fm USING (term), (SELECT count(*) AS fn, avg(len) AS al FROM fd) GROUP BY query_id, id HAVING count(*) = (SELECT count(*) FROM fm z WHERE z.query_id = fm.query_id)),
fr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM fc QUALIFY rank <= 30),
lex AS (SELECT query_id, id, round(max(score) OVER (PARTITION BY query_id) / score, 6) AS score, rank FROM fr UNION ALL SELECT query_id, id, score, rank FROM bm25 WHERE query_id NOT IN (SELECT query_id FROM fr))"""
RECALL = f"""{SHORT}, {EDGES}, {BRIDGE}, {asked(*Q.RECALLS)}, dx AS (SELECT id, text FROM mem WHERE status <> 'retired'), {bm25('dx')}, {LEXICAL},
tm AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM (SELECT query_id, id, round(exp(-abs(epoch_us(learned_at) - epoch_us(tday)) / CAST(8.64e10 AS DOUBLE) / 10), 6) AS score FROM mem, (VALUES (1::BIGINT, TIMESTAMP '2024-01-15'), (2, TIMESTAMP '2024-01-25')) AS t(query_id, tday) WHERE status <> 'retired') WHERE score > 0.2 QUALIFY rank <= 50),
{bfs('tm', 'e.dst')}, temporal AS (SELECT * FROM (SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM reach) WHERE rank <= 30),
top10 AS (SELECT * FROM lex WHERE rank <= 10), {graph('top10')}, {fuse('lex', 'temporal', 'graph')}, {ACTIVATED}, {RERANKED}, {trim(2048)}"""

DECAYED = "(CAST(0.05 AS DOUBLE) + (strength - CAST(0.05 AS DOUBLE)) * exp(-(CASE layer WHEN 'mental_model' THEN CAST(0.01 AS DOUBLE) WHEN 'observation' THEN CAST(0.025 AS DOUBLE) WHEN 'raw' THEN CAST(0.05 AS DOUBLE) ELSE CAST(0.08 AS DOUBLE) END) * (1 - weight / CAST(20 AS DOUBLE)) * days))"
CONFIDENCE = "CAST(greatest(1, floor(1 + (confidence - 1) * exp(-(ln(2) / 90) * (1 - weight / CAST(20 AS DOUBLE)) * days) + CAST(0.5 AS DOUBLE))) AS BIGINT)"
DECAY = f"dm AS (SELECT id, layer, status AS old_status, {status(DECAYED)} AS new_status, round({DECAYED}, 6) AS new_strength, {CONFIDENCE} AS new_confidence FROM (SELECT * REPLACE (greatest(0, epoch_us({NOW}) - epoch_us(CAST(CAST(coalesce(last_accessed, learned_at) AS DATE) AS TIMESTAMP))) / CAST(8.64e10 AS DOUBLE) AS days) FROM mem WHERE layer <> 'experience' AND status NOT IN ('locked', 'retired')) WHERE days >= 0.5)"
SIGNAL = "fb AS (SELECT user_id AS memory_id, ts, event_id AS ord, CASE event_type WHEN 'purchase' THEN 'positive' WHEN 'error' THEN 'negative' ELSE 'neutral' END AS signal FROM events)"
TOP_STATEMENT = "(array_agg(statement ORDER BY round(-(confidence + CAST(0.01 AS DOUBLE) * length(statement)), 6), id))[1]"
INDUCED = f"""kb AS (SELECT *, scope || '|' || domain || '|' || array_to_string(list_sort(tags)[1:3], '+') AS key FROM mem WHERE layer IN ('observation', 'mental_model') AND status IN ('active', 'candidate')),
shd AS (SELECT key, count(*) AS shared FROM (SELECT key, tag, count(*) AS n FROM (SELECT DISTINCT key, id, unnest(tags) AS tag FROM kb) GROUP BY ALL HAVING count(*) >= 2) GROUP BY key),
ig AS (SELECT key, count(*) AS members, CAST(sum(proof) AS BIGINT) AS proof, avg(confidence) AS conf, sum(weight) AS w, min(learned_at) AS first_seen, max(learned_at) AS last_seen, {TOP_STATEMENT} AS top FROM kb GROUP BY key HAVING count(*) >= 3),
ix AS (SELECT ig.*, round(proof + conf / 2 + CAST(0.5 AS DOUBLE) * coalesce(shared, 0), 6) AS score FROM ig LEFT JOIN shd USING (key))"""
REVIEWED = "rv AS (SELECT id, layer, status, CASE WHEN status = 'candidate' AND confidence <= 4 THEN 1 ELSE 0 END + CASE WHEN negative > positive THEN 2 ELSE 0 END + CASE WHEN regexp_matches(statement || chr(10) || scope, '(?i)\\bmarker\\b|dogfood|smoke|cli-explain|telegram-live|\\b[a-z]+(?:-[a-z0-9]+){2,}-\\d{8,}') THEN 3 ELSE 0 END AS score, status = 'candidate' AND confidence <= 4 AS a, negative > positive AS b, regexp_matches(statement || chr(10) || scope, '(?i)\\bmarker\\b|dogfood|smoke|cli-explain|telegram-live|\\b[a-z]+(?:-[a-z0-9]+){2,}-\\d{8,}') AS c FROM mem)"
VERSIONS = """o AS (SELECT o_orderkey AS id, o_orderstatus AS value FROM orders), cur AS (SELECT id, CASE WHEN id % 5 = 0 THEN 'ours' ELSE value END AS value FROM o WHERE id % 7 <> 0),
lat AS (SELECT id, CASE WHEN id % 3 = 0 THEN 'theirs' ELSE value END AS value FROM o WHERE id % 11 <> 0), snap AS (SELECT * FROM o WHERE id % 13 <> 0)"""
COLLAPSED = "trim(regexp_replace({}, '\\s+', ' ', 'g'))"


def sql(body: str, *ctes: str, recursive: bool = False) -> str:
    return (f"WITH {'RECURSIVE ' if recursive else ''}{', '.join(ctes)} " if ctes else "") + body


SCOPED = dims("round(act, 6)", "CAST(CASE WHEN scope = 'global' THEN 0.7 WHEN scope = 'project:src3' THEN 1 WHEN starts_with(scope, 'project:src3') OR starts_with('project:src3', scope) THEN 0.8 ELSE 0.3 END AS DOUBLE)")
GATE = """length(s) >= 8 AND NOT regexp_matches(s, '[吧吗呢啊哦？?]$') AND NOT (regexp_matches(s, '^(应该是|不是)[A-Za-z0-9_]') AND NOT regexp_matches(s, '[。.!！;；]$')) AND NOT (regexp_matches(s, '^不是[A-Za-z0-9_]') AND NOT regexp_matches(s, '[A-Za-z0-9_-]{4,}'))
 AND NOT regexp_matches(s, '[能会][用做]?吗|能用[吗？]') AND NOT regexp_matches(s, '[,，、…]$')"""
REDACTED = "regexp_replace(regexp_replace({}, '\\b(?:sk|ghp|github_pat|xox[baprs]|hf|tp)-[A-Za-z0-9_\\-]{{16,}}\\b', '[REDACTED_SECRET]', 'g'), '((?:password|passwd|密码|口令|token|api[_\\s-]?key)[：:=\\s]+)([^\\s，。,''\"`]{{6,}})', '\\1[REDACTED_SECRET]', 'gi')"
HASHED = "'sha256:' || sha256(trim(regexp_replace(lower({}), '\\s+', ' ', 'g')))"
INDEX = """ir AS (SELECT id, CASE layer WHEN 'raw' THEN 'engram' ELSE layer END AS layer, status, statement, array_to_string(tags, ' ') AS tags, scope, domain, confidence, (strength + storage) / 2 AS activation, learned_at AS created_at, learned_at AS updated_at FROM mem),
io AS (SELECT * REPLACE (CAST(0.125 AS DOUBLE) AS activation, TIMESTAMP '2023-01-01' AS created_at, CASE WHEN id % 2 = 0 THEN updated_at + to_seconds(1) ELSE updated_at END AS updated_at) FROM ir WHERE id % 5 <> 0)"""


def greedy(least: float, where: str = "TRUE") -> str:
    """CTEs ending in gc(id, seed): in id order the first free vector seeds a cluster and takes all similar free ones."""
    return f"""v AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE {where}),
pr AS (SELECT a.id AS a, b.id AS b FROM v a JOIN v b ON a.id < b.id WHERE round(list_dot_product(a.e, b.e), 6) >= {least}),
nb AS (SELECT v.id, row_number() OVER (ORDER BY v.id) AS i, coalesce(l, []) AS l FROM v LEFT JOIN (SELECT b, list(a) AS l FROM pr GROUP BY b) ON b = v.id),
st(i, seeds) AS (SELECT 0::BIGINT, CAST([] AS BIGINT[]) UNION ALL SELECT nb.i, CASE WHEN list_has_any(seeds, l) THEN seeds ELSE list_append(seeds, id) END FROM st JOIN nb ON nb.i = st.i + 1),
sd AS (SELECT unnest(seeds) AS seed FROM st WHERE i = (SELECT max(i) FROM st)),
ow AS (SELECT b AS id, min(a) AS seed FROM pr JOIN sd ON sd.seed = a GROUP BY b),
gc AS (SELECT v.id, CASE WHEN sd.seed IS NOT NULL THEN v.id ELSE ow.seed END AS seed FROM v LEFT JOIN sd ON sd.seed = v.id LEFT JOIN ow ON ow.id = v.id)"""


#: Raw memories in clusters of two or more.
GROUPED = greedy(0.2, "vec_id IN (SELECT id FROM mem WHERE layer = 'raw')") + ", gr AS (SELECT m.*, seed FROM mem m JOIN gc USING (id) WHERE seed IN (SELECT seed FROM gc GROUP BY seed HAVING count(*) > 1))"
BAD = "bad AS (SELECT seed FROM gr GROUP BY seed HAVING count(DISTINCT polarity) > 1)"


#: Memories of three scopes, so that those of different layers share some.
SHARED = MEM.replace("CASE WHEN source IN ('src0', 'src1') THEN 'global' ELSE 'project:' || source END AS scope", "'project:' || doc_id % 3 AS scope")
#: A title of a memory's tags, then its statement.
TITLED = "(array_to_string(tags, ' ') || ' ' || statement)"


def matched(clusters: str, extra: str = "") -> str:
    """CTEs ending in mt(seed, observation, score): the best observation of clusters (seed, scope, domain, w, tags, entities)."""
    return f"""ob AS (SELECT m.id AS observation, scope, domain, {token_set(TITLED)} AS w, tags, coalesce(en, []) AS entities FROM mem m LEFT JOIN en ON en.id = m.id WHERE layer = 'observation' AND status <> 'retired'),
ms AS (SELECT seed, observation, round(CASE WHEN len(c.w) = 0 OR len(o.w) = 0 THEN 0 ELSE len(list_intersect(c.w, o.w)) / CAST(len(list_distinct(list_concat(c.w, o.w))) AS DOUBLE) END + CASE WHEN list_has_any(c.entities, o.entities) THEN CAST(0.35 AS DOUBLE) ELSE 0 END + CASE WHEN list_has_any(c.tags, o.tags) THEN CAST(0.15 AS DOUBLE) ELSE 0 END, 6) AS score FROM {clusters} c JOIN ob o USING (scope, domain){extra}),
mt AS (SELECT seed, observation, score FROM ms WHERE score >= 0.35 QUALIFY row_number() OVER (PARTITION BY seed ORDER BY score DESC, observation) = 1)"""


ENTITIES = "en AS (SELECT l_orderkey AS id, list(DISTINCT CAST(l_partkey % 400 AS VARCHAR)) AS en FROM lineitem GROUP BY 1)"


def extraction(i: int, r) -> str:
    """Candidates (doc_id, rule_ord, ...) of one rule, its pattern in RE2's dialect."""
    quote = lambda x: "'" + x.replace("'", "''") + "'"
    pattern = r.pattern.replace(R.B, "\\b").replace(R.E, "\\b")
    group = lambda g: f"regexp_extract(t, {quote(pattern)}, {g})"
    clean = lambda x: f"regexp_replace(trim({x}), '[。.!！?？]+$', '')" if r.clean else x
    parts, rest = [], r.statement
    for g in (1, 2):
        if f"{{{g}}}" in rest:
            head, rest = rest.split(f"{{{g}}}", 1)
            parts += [quote(head), clean(group(g))]
    said = " || ".join([*parts, quote(rest)])
    hints = " OR ".join(f"contains(l, {quote(h)})" for h in r.hints)
    polarity = quote(r.polarity) if r.polarity else "NULL"
    return f"SELECT doc_id, {i} AS rule_ord, {quote(r.name)} AS rule, {polarity} AS polarity, {quote(r.domain)} AS domain, {said} AS s, {r.confidence} AS confidence FROM tx WHERE ({hints}) AND regexp_matches(t, {quote(pattern)})"


DX = "dx AS (SELECT doc_id AS id, text FROM documents)"
SUBSTRING = (
    asked("apache license", "tion", "an it", "tion ung"),
    "tm AS (SELECT query_id, unnest(list_distinct(list_filter(string_split(query, ' '), lambda t: length(t) >= 3))) AS term FROM q)",
    "dl AS (SELECT doc_id AS id, lower(text) AS t, greatest(0, length(text) - 2) AS len FROM documents), n AS (SELECT count(*) AS n, avg(len) AS al FROM dl)",
    "h AS (SELECT id, len, term, (length(t) - length(replace(t, term, ''))) / CAST(length(term) AS DOUBLE) AS tf FROM dl, (SELECT DISTINCT term FROM tm) WHERE contains(t, term)), d AS (SELECT term, count(*) AS df FROM h GROUP BY term)",
    "sc AS (SELECT query_id, id, round(sum(greatest(ln((n - df + CAST(0.5 AS DOUBLE)) / (df + CAST(0.5 AS DOUBLE))), CAST(1e-6 AS DOUBLE)) * tf * CAST(2.2 AS DOUBLE) / (tf + CAST(1.2 AS DOUBLE) * (CAST(0.25 AS DOUBLE) + CAST(0.75 AS DOUBLE) * len / al))), 6) AS score FROM h JOIN d USING (term) JOIN tm USING (term), n GROUP BY query_id, id HAVING count(*) = (SELECT count(*) FROM tm z WHERE z.query_id = tm.query_id))",
)
FOLDED = "memory_id, round(ss, 6) AS storage, round(rs, 6) AS strength, CAST(conf AS BIGINT) AS confidence, positive, negative FROM fold JOIN (SELECT memory_id, max(i) AS i, count(*) FILTER (signal = 'positive') AS positive, count(*) FILTER (signal = 'negative') AS negative FROM o GROUP BY memory_id) USING (memory_id, i)"
FOLD = (
        SIGNAL,
        "o AS (SELECT memory_id, signal, row_number() OVER (PARTITION BY memory_id ORDER BY ts, ord) AS i FROM fb)",
        """fold(memory_id, i, ss, rs, conf) AS (SELECT DISTINCT memory_id, 0::BIGINT, 0.5::DOUBLE, 0.5::DOUBLE, 5 FROM o UNION ALL SELECT f.memory_id, o.i,
 CASE signal WHEN 'positive' THEN least(1.0, ss + 0.1::DOUBLE) WHEN 'negative' THEN greatest(0.0::DOUBLE, ss - 0.15::DOUBLE) ELSE ss END,
 CASE signal WHEN 'positive' THEN least(1.0, rs + 0.05::DOUBLE) WHEN 'negative' THEN greatest(0.0::DOUBLE, rs - 0.1::DOUBLE) ELSE rs END,
 CASE signal WHEN 'positive' THEN least(10, conf + 1) WHEN 'negative' THEN greatest(1, conf - 1) ELSE conf END FROM fold f JOIN o ON o.memory_id = f.memory_id AND o.i = f.i + 1)""",
)
ORACLE_SQL: dict[str, str] = {
    "tokenize_counts": sql(f"SELECT id, CAST(len(ts) AS BIGINT) AS n_tokens, CAST(len(list_distinct(ts)) AS BIGINT) AS n_distinct FROM (SELECT doc_id AS id, {WORDS} AS ts FROM documents)"),
    "cjk_ngrams": f"SELECT CAST(id AS INTEGER) AS id, array_to_string(list_sort({tokens('s')}), ',') AS tokens FROM {values(list(enumerate(Q.CJK_SAMPLES)), 'id, s')}",
    "token_set_jaccard": sql(f"SELECT conv_id, turn, round(CASE WHEN len(a) = 0 OR len(b) = 0 THEN 0 ELSE len(list_intersect(a, b)) / CAST(len(list_distinct(list_concat(a, b))) AS DOUBLE) END, 6) AS similarity FROM (SELECT conv_id, turn, {token_set('\"user\"')} AS a, {token_set('assistant')} AS b FROM pairs)", PAIRS),
    "content_hash": "SELECT doc_id AS id, 'sha256:' || sha256(trim(regexp_replace(lower(text), '\\s+', ' ', 'g'))) AS hash FROM documents",
    "estimate_tokens": "SELECT doc_id AS id, CAST(ceil(length(text) / CAST(4 AS DOUBLE)) AS BIGINT) AS tokens FROM documents",
    "redact_sensitive": f"SELECT doc_id AS id, sha256({REDACTED.format('text')}) AS redacted FROM documents",
    "redact_samples": f"SELECT CAST(id AS INTEGER) AS id, {REDACTED.format('s')} AS redacted, {REDACTED.format('s')} <> s AS secret FROM {values(list(enumerate(Q.SECRET_SAMPLES)), 'id, s')}",
    "quality_samples": f"SELECT CAST(id AS INTEGER) AS id, {GATE} AS passes FROM {values(list(enumerate(Q.GATE_SAMPLES)), 'id, s')}",
    "compression_insights": "SELECT CAST(conv_id AS BIGINT) AS conv_id, CAST(turn AS BIGINT) AS turn, insight FROM (VALUES (1, 5, '不要 use tabs'), (1, 6, '以后 run tests'), (2, 1, '我喜欢 dark mode')) AS t(conv_id, turn, insight)",
    "message_texts": f"SELECT CAST(id AS INTEGER) AS id, text FROM {values(list(enumerate(('plain', 'inside', 'a' + chr(10) + 'b' + chr(10), '', '', ''))), 'id, text')}",
    "string_lists": f"SELECT CAST(id AS INTEGER) AS id, tags FROM {values(list(enumerate(('a|b|c', '', '', 'one'))), 'id, tags')}",
    "activation_json": "SELECT CAST(id AS INTEGER) AS id, CAST(strength AS DOUBLE) AS strength, CAST(storage AS DOUBLE) AS storage, CAST(frequency AS BIGINT) AS frequency, CAST(turns AS BIGINT) AS turns, last_accessed FROM (VALUES (0, 0.5, 0.25, 3, 0, '2024-01-01'), (1, 1.0, 0.0, 3, 7, '2024-01-02'), (2, NULL, NULL, NULL, NULL, NULL), (3, NULL, NULL, NULL, NULL, NULL), (4, NULL, NULL, NULL, NULL, NULL), (5, NULL, NULL, NULL, NULL, NULL)) AS t(id, strength, storage, frequency, turns, last_accessed)",
    "fact_samples": "SELECT CAST(id AS INTEGER) AS id, CAST(pos AS INTEGER) AS pos, statement, type, polarity, CAST(confidence AS BIGINT) AS confidence, entities FROM (VALUES (0, 0, 'the port is 8443', 'procedural', 'do', 10, ''), (1, 0, 'tabs are out', 'behavioral', NULL, 3, 'tabs:concept')) AS t(id, pos, statement, type, polarity, confidence, entities)",
    "memory_names": sql("SELECT id, name, CAST(CAST(learned_at AS DATE) AS VARCHAR) AS day FROM (SELECT id, learned_at, CASE layer WHEN 'raw' THEN 'ENG' WHEN 'observation' THEN 'OBS' WHEN 'mental_model' THEN 'MM' ELSE 'EXP' END || '-' || strftime(learned_at, '%Y%m%d') || '-' || CASE WHEN id % 1500 < 1000 THEN lpad(CAST(id % 1500 AS VARCHAR), 3, '0') ELSE CAST(id % 1500 AS VARCHAR) END AS name FROM mem)", MEM),
    "promotions": sql(f"SELECT id, copies FROM (SELECT id, status, count(*) OVER (PARTITION BY {HASHED.format('statement')}) AS copies FROM mem) WHERE status = 'candidate' AND copies >= 2", MEM),
    "strip_context": f"SELECT CAST(id AS INTEGER) AS id, trim(regexp_replace(regexp_replace(regexp_replace(s, '^\\s*\\[Replying to:\\s*\"[\\s\\S]*?\"\\]\\s*', ''), '(?is)<memory-context>.*?</memory-context>', '', 'g'), '(?is)\\[System note:.*?\\]\\s*', '', 'g')) AS stripped FROM {values(list(enumerate(Q.CONTEXT_SAMPLES)), 'id, s')}",
    "quality_gate": sql(f"SELECT id, {GATE} AS passes FROM (SELECT id, trim(statement) AS s FROM mem)", MEM),
    "extract_entities": """WITH f AS (SELECT doc_id AS id, 1 AS k, 'url' AS type, unnest(regexp_extract_all(text, 'https?://[^\\s，。''"`]+')) AS name FROM documents
 UNION ALL SELECT doc_id, 2, 'version', unnest(regexp_extract_all(text, '\\bv\\d+\\.\\d+\\.\\d+\\b')) FROM documents UNION ALL SELECT doc_id, 3, 'tool', unnest(regexp_extract_all(text, '(?i)\\b[a-z]{2,}(?:[-_][a-z0-9]+){1,4}\\b')) FROM documents
 UNION ALL SELECT doc_id, 4, 'concept', unnest(regexp_extract_all(text, '[''"`]([^''"`]{3,40})[''"`]', 1)) FROM documents)
SELECT id, name, arg_min(type, k) AS type FROM f WHERE length(name) > 2 GROUP BY id, name""",
    "summarize_turn": sql(f"SELECT conv_id, turn, CASE WHEN a <> '' AND b <> '' THEN 'User: ' || substr(a, 1, 140) || ' | Assistant: ' || substr(b, 1, 140) ELSE substr(a || b, 1, 280) END AS summary FROM (SELECT conv_id, turn, {COLLAPSED.format('\"user\"')} AS a, {COLLAPSED.format('assistant')} AS b FROM pairs)", PAIRS),
    "infer_pattern": "SELECT doc_id AS id, CASE " + " ".join(f"WHEN regexp_matches(lower(text), '{w}') THEN '{k}'" for k, w in R.PATTERN_KINDS) + " ELSE 'recurring' END AS pattern FROM documents",
    "learnable_turns": "SELECT conv_id, turn, trim(text) <> '' AND (" + " OR ".join(f"contains(lower(text), '{m.replace(chr(39), chr(39) * 2)}')" for m in R.LEARN_MARKERS) + ") AS learnable FROM conversations WHERE role = 'user'",
    "time_references": "SELECT CAST(query_id AS BIGINT) AS query_id, day FROM (VALUES (1, '2024-01-15'), (2, '2024-02-01'), (3, '2024-01-31'), (4, '2024-01-31'), (5, '2024-01-25'), (6, '2024-01-02'), (7, NULL)) AS t(query_id, day)",
    "document_frequency": f"SELECT token, count(*) AS df FROM (SELECT unnest(list_distinct({WORDS})) AS token FROM documents) GROUP BY token",
    "bm25_topk": sql("SELECT id, score, rank FROM bm25", asked(*Q.ONE), DX, bm25("dx")),
    "bm25_batch": sql("SELECT * FROM bm25", asked(*Q.MANY), DX, bm25("dx")),
    "substring_rank": sql(
        "SELECT query_id, id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM sc) WHERE rank <= 30",
        *SUBSTRING,
    ),
    "fts_grammar": sql(
        "SELECT query_id, id, score, rank FROM (SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM sc) WHERE rank <= 30",
        "tm AS (SELECT * FROM (VALUES (1::BIGINT, 'the of'), (2, 'license'), (2, 'tion'), (3, 'tion'), (3, 'the'), (4, 'apache'), (4, 'mit'), (4, 'license'), (7, 'license'), (7, 'apache'), (7, 'mit'), (8, 'tion,'), (8, 'the')) AS t(query_id, term))",
        *SUBSTRING[2:4],
        "hs AS (SELECT query_id, id, list(term) AS has, round(sum(greatest(ln((n - df + CAST(0.5 AS DOUBLE)) / (df + CAST(0.5 AS DOUBLE))), CAST(1e-6 AS DOUBLE)) * tf * CAST(2.2 AS DOUBLE) / (tf + CAST(1.2 AS DOUBLE) * (CAST(0.25 AS DOUBLE) + CAST(0.75 AS DOUBLE) * len / al))), 6) AS score FROM h JOIN d USING (term) JOIN tm USING (term), n GROUP BY query_id, id)",
        "sc AS (SELECT query_id, id, score FROM hs WHERE CASE query_id WHEN 3 THEN list_contains(has, 'tion') AND NOT list_contains(has, 'the') WHEN 4 THEN len(list_intersect(has, ['apache', 'mit'])) > 0 AND list_contains(has, 'license') WHEN 7 THEN has = ['license'] WHEN 8 THEN len(has) = 2 ELSE true END)",
    ),
    "fts_normalised": sql(
        "SELECT query_id, id, round(max(score) OVER (PARTITION BY query_id) / score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM sc) WHERE rank <= 30",
        *SUBSTRING,
    ),
    "keyword_search": sql("SELECT id, layer FROM mem WHERE contains(lower(statement || ' ' || array_to_string(tags, ' ')), 'license') OR contains(lower(statement || ' ' || array_to_string(tags, ' ')), 'src1')", MEM),
    "semantic_topk": "SELECT * FROM (SELECT id, score, row_number() OVER (ORDER BY score DESC, id) AS rank FROM (SELECT b.vec_id AS id, round(greatest(0, list_dot_product(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[]))), 6) AS score FROM embeddings a, embeddings b WHERE a.vec_id = 0) WHERE score >= 0.2) WHERE rank <= 30",
    "semantic_index": "SELECT query_id, id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM (SELECT a.vec_id AS query_id, b.vec_id AS id, round(greatest(0, list_dot_product(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[]))), 6) AS score FROM embeddings a, embeddings b WHERE a.vec_id % 50 = 0) WHERE score >= 0.2) WHERE rank <= 30",
    "semantic_pairs": "SELECT * FROM (SELECT a.vec_id AS a, b.vec_id AS b, round(list_dot_product(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 6) AS similarity FROM embeddings a, embeddings b WHERE a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id) WHERE similarity >= 0.30",
    "time_relevance": sql("SELECT * FROM (SELECT id, round(exp(-abs(epoch_us(learned_at) - epoch_us(TIMESTAMP '2024-01-15')) / CAST(8.64e10 AS DOUBLE) / 10), 6) AS score FROM mem) WHERE score > 0.2", MEM),
    "temporal_search": sql("SELECT query_id, id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM (SELECT query_id, id, round(exp(-abs(epoch_us(learned_at) - epoch_us(tday)) / CAST(8.64e10 AS DOUBLE) / 10), 6) AS score FROM mem, (VALUES (1::BIGINT, TIMESTAMP '2024-01-15'), (2, TIMESTAMP '2024-01-25')) AS t(query_id, tday) WHERE status <> 'retired') WHERE score > 0.2) WHERE rank <= 50", MEM),
    "temporal_bfs": sql("SELECT query_id, id, score, CAST(round AS INTEGER) AS round FROM reach", EDGES, SEEDS, bfs("seeds", "e.src * 2 + CASE WHEN e.type = 'temporal' THEN 1 ELSE 0 END")),
    "entity_neighbors": sql("SELECT o.query_id, o.seed, b.memory_id AS id, count(*) AS shared FROM (SELECT s.query_id, s.id AS seed, entity FROM (VALUES (1::BIGINT, 1::BIGINT), (1, 2), (2, 32)) AS s(query_id, id) JOIN br ON memory_id = s.id) o JOIN br b USING (entity) WHERE b.memory_id <> o.seed GROUP BY ALL", BRIDGE),
    "link_expansion": sql("SELECT s.query_id, s.id AS seed, e.dst AS id, type, round(weight, 6) AS weight FROM seeds s JOIN ed e ON e.src = s.id UNION ALL SELECT s.query_id, s.id, e.src, type, round(weight, 6) FROM seeds s JOIN ed e ON e.dst = s.id", EDGES, SEEDS),
    "graph_expansion": sql("SELECT query_id, id, score, rank FROM graph", EDGES, BRIDGE, SEEDS, graph("seeds")),
    "temporal_edges": sql("SELECT a.id AS src, b.id AS dst, round(1 - abs(epoch_us(a.learned_at) - epoch_us(b.learned_at)) / CAST(7200000000 AS DOUBLE), 6) AS weight FROM mem a JOIN mem b ON a.id < b.id AND abs(epoch_us(a.learned_at) - epoch_us(b.learned_at)) <= 7200000000", MEM),
    "temporal_edges_first": sql("SELECT DISTINCT least(a.id, b.id) AS src, greatest(a.id, b.id) AS dst, round(1 - abs(epoch_us(a.learned_at) - epoch_us(b.learned_at)) / CAST(7200000000 AS DOUBLE), 6) AS weight FROM mem a JOIN mem b ON a.id <> b.id AND abs(epoch_us(a.learned_at) - epoch_us(b.learned_at)) <= 7200000000 WHERE a.id IN (SELECT DISTINCT memory_id FROM br ORDER BY 1 LIMIT 100)", MEM, BRIDGE),
    "coaccess_edges": sql("SELECT DISTINCT least(a.memory_id, b.memory_id) AS src, greatest(a.memory_id, b.memory_id) AS dst, round(count(*) / CAST(max(greatest(x.n, y.n)) AS DOUBLE), 6) AS weight FROM br a JOIN br b ON a.entity = b.entity AND a.memory_id <> b.memory_id JOIN sz x ON x.memory_id = a.memory_id JOIN sz y ON y.memory_id = b.memory_id WHERE a.memory_id IN (SELECT DISTINCT memory_id FROM br ORDER BY 1 LIMIT 100) AND (least(a.memory_id, b.memory_id), greatest(a.memory_id, b.memory_id)) NOT IN (SELECT (least(src, dst), greatest(src, dst)) FROM ed) GROUP BY a.memory_id, b.memory_id", BRIDGE, EDGES, "sz AS (SELECT memory_id, count(*) AS n FROM br GROUP BY memory_id)"),
    "graph_entities": sql("SELECT entity, count(*) AS memories FROM br GROUP BY entity", BRIDGE),
    "rrf_fuse": sql("SELECT query_id, id, score, rank FROM fused", MEM, LISTS, fuse("bm25", "near")),
    "activation_weight": sql("SELECT query_id, id, relevance FROM av", MEM, LISTS, fuse("bm25", "near"), ACTIVATED),
    "rerank_dims": sql("SELECT id, " + ", ".join(f"round({v}, 6) AS d_{k}" for k, v in SCOPED.items()) + f", {total(SCOPED)} AS score FROM mem WHERE status <> 'retired'", MEM),
    "token_budget_trim": sql("SELECT query_id, id, layer FROM kept", SHORT, LISTS, fuse("bm25", "near", k=120), ACTIVATED, RERANKED, trim(1024), recursive=True),
    "injection_text": sql(
        "SELECT query_id, '<memory-context>' || chr(10) || coalesce(body, '(no relevant memories)') || chr(10) || '</memory-context>' AS text FROM (SELECT unnest(range(1, 7)) AS query_id) LEFT JOIN (SELECT query_id, array_to_string(list(t ORDER BY s), chr(10) || chr(10)) AS body FROM (SELECT query_id, s, ['### Directives (must follow)', '### Constraints', '### Consider'][s + 1] || chr(10) || array_to_string(list('[' || id || '] ' || statement ORDER BY rank), chr(10)) AS t FROM (SELECT *, CASE layer WHEN 'mental_model' THEN 0 WHEN 'observation' THEN 1 ELSE 2 END AS s FROM kept) GROUP BY query_id, s) GROUP BY query_id) USING (query_id)",
        SHORT, LISTS, fuse("bm25", "near", k=120), ACTIVATED, RERANKED, trim(1024), recursive=True,
    ),
    "recall_full": sql("SELECT query_id, id, layer, score, rank FROM kept", RECALL, recursive=True),
    "recall_explain": sql(
        """SELECT k.query_id, k.id, b.rank AS bm25_rank, t.rank AS temporal_rank, g.rank AS graph_rank, b.score AS bm25_score, g.score AS graph_score, k.rrf, round(k.act, 6) AS act, k.relevance, k.score AS rerank,
 CASE WHEN coalesce(b.rank, t.rank, g.rank) IS NULL THEN 'No retrieval signals matched' ELSE 'Matched retrieval signals: ' || concat_ws(', ', CASE WHEN b.rank > 0 THEN 'bm25' END, CASE WHEN t.rank > 0 THEN 'temporal' END, CASE WHEN g.rank > 0 THEN 'graph' END) END AS reason
 FROM kept k LEFT JOIN lex b ON b.query_id = k.query_id AND b.id = k.id LEFT JOIN temporal t ON t.query_id = k.query_id AND t.id = k.id LEFT JOIN graph g ON g.query_id = k.query_id AND g.id = k.id""",
        RECALL, recursive=True,
    ),
    "recall_diagnostics": sql(
        "SELECT q.query_id, (SELECT count(*) FROM mem WHERE status <> 'retired') AS corpus_size, " + ", ".join(f"(SELECT count(*) FROM {t} x WHERE x.query_id = q.query_id) AS {n}" for n, t in (("bm25", "lex"), ("temporal", "temporal"), ("graph", "graph"), ("ranked", "rk"), ("kept", "kept")))
        + ", CASE WHEN (SELECT count(*) FROM kept x WHERE x.query_id = q.query_id) > 0 THEN NULL WHEN (SELECT count(*) FROM rk x WHERE x.query_id = q.query_id) = 0 THEN 'No retrieval signals matched this query.' ELSE 'Retrieval candidates were filtered out by token budget or relevance gates.' END AS reason FROM q",
        RECALL, recursive=True,
    ),
    "embed_batch": "SELECT doc_id AS key, length(text) AS length, doc_id % 3 = 0 OR doc_id % 5 = 0 AS new FROM documents WHERE text IS NOT NULL",
    "decay_strength": sql(f"SELECT id, round({DECAYED}, 6) AS strength FROM mem", MEM),
    "activation_score": sql("SELECT id, round(act, 6) AS activation FROM mem", MEM),
    "activation_values": sql("SELECT id, round((strength + storage) / 2, 6) AS value, round(least(1.0, strength + CAST(0.1 AS DOUBLE)), 6) AS touched FROM mem", MEM),
    "quality_score": sql(f"SELECT id, round({QUALITY}, 6) AS quality FROM mem", MEM),
    "confidence_decay": sql(f"SELECT id, {CONFIDENCE} AS confidence FROM mem", MEM),
    "batch_decay": sql("SELECT * FROM dm", MEM, DECAY),
    "status_changes": sql("SELECT layer, old_status, new_status, count(*) AS n FROM dm WHERE old_status <> new_status GROUP BY ALL", MEM, DECAY),
    "dedup_actions": "SELECT id, CASE WHEN id = target THEN 'ADD' ELSE 'SKIP' END AS action, target FROM (SELECT doc_id AS id, min(doc_id) OVER (PARTITION BY trim(regexp_replace(lower(text), '\\s+', ' ', 'g'))) AS target FROM documents)",
    "learn_candidates": "WITH tx AS (SELECT doc_id, trim(text) AS t, lower(trim(text)) AS l FROM documents WHERE trim(text) <> '' AND NOT (" + " OR ".join(f"contains(lower(text), '{m}')" for m in R.META_MARKERS) + ")), c AS (" + " UNION ALL ".join(extraction(i, r) for i, r in enumerate(R.EXTRACTIONS))
    + f") SELECT doc_id, rule, polarity, domain, sha256(s) AS statement, CAST(confidence AS BIGINT) AS confidence FROM (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY doc_id, s ORDER BY rule_ord) = 1) WHERE {GATE.replace('(s', '(trim(s)')}",
    "learn_samples": f"SELECT CAST(id AS INTEGER) AS id, rule, statement FROM {values([(0, 'remember', 'the staging port is 8443'), (1, 'do_not', 'use tabs in yaml files'), (2, 'use_instead', 'Default to ripgrep instead of grep.'), (3, 'secret_value', '用户配置了敏感凭据；不得保存或复述原始凭据值。'), (4, 'remember_zh', '每天先跑测试再提交代码'), (6, 'always', 'run the linter before pushing')], 'id, rule, statement')}",
    "feedback_fold": sql(
        f"SELECT {FOLDED}",
        *FOLD, recursive=True,
    ),
    "stream_feedback_values": sql(
        f"SELECT f.*, CAST(r.retired_at AS VARCHAR) AS retired_at FROM (SELECT {FOLDED}) f LEFT JOIN (SELECT memory_id, min(ts) AS retired_at FROM (SELECT memory_id, CAST(ts AS TIMESTAMP) AS ts, count(*) OVER (PARTITION BY memory_id ORDER BY CAST(ts AS TIMESTAMP) RANGE BETWEEN INTERVAL 30 DAY PRECEDING AND CURRENT ROW) AS n FROM fb WHERE signal = 'negative') WHERE n >= 3 GROUP BY memory_id) r USING (memory_id)",
        *FOLD, recursive=True,
    ),
    "auto_retire": sql(f"SELECT memory_id, recent, recent >= 3 AS retire FROM (SELECT memory_id, count(*) FILTER (signal = 'negative' AND ts >= {NOW} - INTERVAL 30 DAY) AS recent FROM fb GROUP BY memory_id)", SIGNAL),
    "feedback_summary": sql("SELECT memory_id, count(*) FILTER (signal = 'positive') AS positive, count(*) FILTER (signal = 'negative') AS negative, count(*) FILTER (signal = 'neutral') AS neutral, count(*) AS total, array_to_string(list(signal ORDER BY ts DESC, ord DESC)[1:10], ',') AS recent FROM fb GROUP BY memory_id", SIGNAL),
    "feedback_log": sql("SELECT memory_id, row_number() OVER (PARTITION BY memory_id ORDER BY ts DESC, ord DESC) AS rank, ord, signal FROM fb QUALIFY rank <= 5", SIGNAL),
    "consolidate_merge": sql(
        f"SELECT seed, count(*) AS members, count(*) AS evidence, count(DISTINCT id) AS sources, round(max(strength), 6) AS strength, round(max(storage), 6) AS storage, CAST(sum(frequency) AS BIGINT) AS frequency, CAST(sum(turns) AS BIGINT) AS turns, max(weight) AS weight, CAST(least(10, floor(avg(confidence) + 1.5)) AS BIGINT) AS confidence, array_to_string(list_sort(list_distinct(flatten(list(tags)))), ',') AS tags, CAST(min(learned_at) AS VARCHAR) AS learned_at, sha256({TOP_STATEMENT}) AS statement, {TOP_STATEMENT.replace('statement ORDER', 'scope ORDER')} AS scope, {TOP_STATEMENT.replace('statement ORDER', 'domain ORDER')} AS domain, count(DISTINCT polarity) > 1 AS conflict FROM gr GROUP BY seed",
        MEM, GROUPED, recursive=True,
    ),
    "polarity_conflict": sql("SELECT seed, count(DISTINCT polarity) AS kinds FROM gr GROUP BY seed HAVING count(DISTINCT polarity) > 1", MEM, GROUPED, recursive=True),
    "experience_groups": sql("SELECT key, members, score FROM ix", MEM, INDUCED),
    "experience_new_groups": sql("SELECT key, members, score FROM ix WHERE key NOT IN (SELECT key FROM (SELECT key, x.id AS e, count(*) AS n FROM kb JOIN (SELECT id, unnest([id - 18, id - 17]) AS source_id FROM mem WHERE id % 20 = 19 AND id // 20 % 3 = 0 AND status <> 'retired') x ON x.source_id = kb.id GROUP BY ALL) JOIN ig USING (key) WHERE n >= least(members, 2))", MEM, INDUCED),
    "experience_synth": sql("SELECT key, sha256('Repeated pattern across ' || members || ' memories: ' || top) AS statement, tags, pattern, CAST(greatest(1, least(10, floor(conf + least(2.0, members / CAST(3 AS DOUBLE)) + CAST(0.5 AS DOUBLE)))) AS BIGINT) AS confidence, CAST(greatest(1, least(10, floor(w / members + CAST(0.5 AS DOUBLE)))) AS BIGINT) AS weight, greatest(members, proof) AS occurrence, CAST(first_seen AS VARCHAR) AS first_seen, CAST(last_seen AS VARCHAR) AS last_seen FROM (SELECT *, row_number() OVER (ORDER BY score DESC, key) AS r FROM ix) JOIN tg USING (key) JOIN pk USING (key) WHERE r <= 5", MEM, INDUCED, "tg AS (SELECT key, array_to_string(list(tag ORDER BY n < 2, tag)[1:12], ',') AS tags FROM (SELECT key, tag, count(*) AS n FROM (SELECT DISTINCT key, id, unnest(tags) AS tag FROM kb) GROUP BY ALL) GROUP BY key)", "pk AS (SELECT key, CASE " + " ".join(f"WHEN bool_or(regexp_matches(lower(statement), '{w}')) THEN '{k}'" for k, w in R.PATTERN_KINDS) + " ELSE 'recurring' END AS pattern FROM kb GROUP BY key)"),
    "experience_evidence": sql("SELECT key, n, id, sha256('[' || n || '] ' || statement) AS line FROM (SELECT key, id, statement, row_number() OVER (PARTITION BY key ORDER BY id) AS n FROM kb WHERE key IN (SELECT key FROM (SELECT key, row_number() OVER (ORDER BY score DESC, key) AS r FROM ix) WHERE r <= 5))", MEM, INDUCED),
    "unmerged_list": sql("SELECT id FROM mem WHERE layer = 'raw' AND status = 'active' AND NOT consolidated ORDER BY learned_at, id LIMIT 50", MEM),
    "store_stats": sql("SELECT layer, status, count(*) AS n FROM mem GROUP BY ALL", MEM),
    "store_counts": sql("SELECT 'memories' AS name, count(*) AS n FROM documents UNION ALL SELECT 'entities', count(DISTINCT entity) FROM br UNION ALL SELECT 'bridge', count(*) FROM br UNION ALL SELECT 'edges', count(*) FROM ed UNION ALL SELECT 'feedback', count(*) FROM events UNION ALL SELECT 'episodes', count(*) FROM conversations", BRIDGE, EDGES),
    "review_scores": sql("SELECT id, layer, status, CAST(score AS BIGINT) AS score, array_to_string(list_filter([CASE WHEN c THEN 'test marker' END, CASE WHEN a THEN 'low-confidence candidate' END, CASE WHEN b THEN 'negative feedback' END], lambda x: x IS NOT NULL), '; ') AS reasons FROM rv WHERE score > 0", MEM, REVIEWED),
    "prune_actions": sql("SELECT id, CASE WHEN status IN ('locked', 'retired') THEN 'skipped' ELSE 'retired' END AS action, CASE status WHEN 'locked' THEN 'locked' WHEN 'retired' THEN 'already retired' ELSE 'selected' END AS reason FROM rv WHERE score > 0", MEM, REVIEWED),
    "prune_by_tag": sql("SELECT mem.id, CAST(coalesce(score, 0) AS BIGINT) AS score, CASE WHEN coalesce(score, 0) = 0 THEN 'tag:src3' ELSE array_to_string(list_filter([CASE WHEN c THEN 'test marker' END, CASE WHEN a THEN 'low-confidence candidate' END, CASE WHEN b THEN 'negative feedback' END], lambda x: x IS NOT NULL), '; ') END AS reasons FROM mem JOIN rv USING (id) WHERE list_contains(tags, 'src3') AND (contains(lower(mem.statement), 'tion') OR contains(lower(scope), 'tion') OR contains(lower(domain), 'tion') OR len(list_filter(tags, lambda t: contains(lower(t), 'tion'))) > 0)", MEM, REVIEWED),
    "retire_tagged": sql("SELECT id, CASE WHEN hit THEN 'retired' ELSE status END AS status, array_to_string(CASE WHEN hit THEN list_append(tags, 'pruned') ELSE tags END, ',') AS tags, CAST(CASE WHEN hit THEN coalesce(vu, TIMESTAMP '2024-02-01') ELSE vu END AS VARCHAR) AS valid_until FROM (SELECT *, CASE WHEN id % 4 = 0 THEN learned_at END AS vu, id % 6 = 0 AND layer <> 'experience' AND status NOT IN ('locked', 'retired') AS hit FROM mem)", MEM),
    "forgotten": sql("SELECT id, CASE WHEN id % 6 = 0 AND layer = 'raw' THEN 'retired' ELSE status END AS status FROM mem", MEM),
    "manual_create": "SELECT CAST(body AS BIGINT) AS body, statement, 'raw' AS layer, status, scope, domain, tags, polarity, CAST(confidence AS DOUBLE) AS confidence, CAST(weight AS DOUBLE) AS weight, CAST(0.8 AS DOUBLE) AS strength, CAST(1 AS DOUBLE) AS storage FROM (VALUES (1, 'use spaces', 'active', 'project:x', 'manual', 'style|python', 'do', 10, 5), (3, 'keep it', 'locked', 'global', 'notes', '', NULL, 7, 1), (4, 'and this', 'active', 'global', 'manual', 'a|b', 'dont', 3.5, 7)) AS t(body, statement, status, scope, domain, tags, polarity, confidence, weight)",
    "manual_patch": sql("SELECT id, CASE WHEN id = 1 THEN 'new' ELSE scope END AS scope, CASE WHEN id = 2 THEN 'locked' ELSE status END AS status, CAST(CASE id WHEN 1 THEN 10 WHEN 2 THEN 1 ELSE confidence END AS BIGINT) AS confidence, CAST(CASE id WHEN 2 THEN 3 WHEN 3 THEN 1 ELSE weight END AS BIGINT) AS weight FROM mem", MEM),
    "field_search": sql("SELECT id FROM mem WHERE contains(lower(statement), 'thtion') OR contains(lower(scope), 'thtion') OR contains(domain, 'thtion')", MEM),
    "memory_list": sql("SELECT id, CAST(learned_at AS VARCHAR) AS learned_at, count(*) OVER () AS total FROM mem WHERE layer = 'raw' AND status = 'active' ORDER BY mem.learned_at DESC, id LIMIT 50", MEM),
    "experience_list": sql("SELECT id, CAST(coalesce(last_seen, learned_at) AS VARCHAR) AS seen FROM mem WHERE layer = 'experience' AND status = 'active' ORDER BY coalesce(last_seen, learned_at) DESC, id LIMIT 20", MEM),
    "recovery_context": """SELECT conv_id, '### Recent Session Context' || chr(10) || array_to_string(list(line ORDER BY turn), chr(10)) AS text FROM (SELECT conv_id, turn, '- [' || strftime(ts, '%Y-%m-%dT%H:%M') || ' ' || CASE WHEN turn % 4 = 0 THEN 'checkpoint:c' || turn ELSE 'turn' END || '] ' || substr(text, 1, 80) || CASE WHEN turn % 3 = 0 THEN chr(10) || '  next: one; two; three' ELSE '' END AS line
 FROM (SELECT *, TIMESTAMP '2024-01-01' + to_seconds(conv_id % 500 * 3600 + turn * 60) AS ts FROM conversations) QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 5) GROUP BY conv_id""",
    "capture_episodes": sql(f"SELECT conv_id, turn, 'turn' AS kind, CASE WHEN a <> '' AND b <> '' THEN 'User: ' || substr(a, 1, 140) || ' | Assistant: ' || substr(b, 1, 140) ELSE substr(a || b, 1, 280) END AS summary, substr(concat_ws(chr(10) || '---' || chr(10), nullif(\"user\", ''), nullif(assistant, '')), 1, 1000) AS context FROM (SELECT *, {COLLAPSED.format('\"user\"')} AS a, {COLLAPSED.format('assistant')} AS b FROM pairs)", PAIRS),
    "checkpoints": "SELECT 'checkpoint' AS kind, label, summary, tags, next_steps, context FROM (VALUES ('before merge', 'before merge', 'checkpoint,x', 'a,b', NULL), ('two', 'said', 'checkpoint', '', 'ctx')) AS t(label, summary, tags, next_steps, context)",
    "evidence_resolve": sql("SELECT owner, CAST(pos AS INTEGER) AS pos, id, status FROM (SELECT o.id AS owner, x.pos, o.id + x.add AS id FROM mem o, (VALUES (0, 5), (1, 3), (3, 4)) AS x(pos, add) WHERE o.layer = 'observation') JOIN (SELECT id, status FROM mem) USING (id)", MEM),
    "association_resolve": sql("SELECT src, id, type, CAST(weight AS DOUBLE) AS weight, status FROM (SELECT m.id AS src, m.id + x.add AS id, x.type, x.weight FROM mem m, (VALUES (1, 'semantic', 0.6), (2, 'causal', 0.7)) AS x(add, type, weight)) JOIN (SELECT id, status FROM mem) USING (id)", MEM),
    "point_lookup": sql("SELECT ir.id, layer, status, len(embedding) AS dimension FROM ir LEFT JOIN embeddings ON vec_id = ir.id WHERE ir.id IN (3, 77)", MEM, INDEX),
    "index_rows": sql("SELECT id, layer, status, sha256(statement) AS statement, tags, scope, domain, confidence, round(activation, 6) AS activation, CAST(updated_at AS VARCHAR) AS updated_at FROM ir", MEM, INDEX),
    "index_rebuild": sql("SELECT ir.id, round(CASE WHEN io.updated_at > ir.updated_at THEN io.activation ELSE ir.activation END, 6) AS activation, CAST(greatest(ir.updated_at, coalesce(io.updated_at, ir.updated_at)) AS VARCHAR) AS updated_at FROM ir LEFT JOIN io USING (id)", MEM, INDEX),
    "index_upsert": sql("SELECT coalesce(n.id, io.id) AS id, round(coalesce(n.activation, io.activation), 6) AS activation, CAST(coalesce(io.created_at, n.created_at) AS VARCHAR) AS created_at FROM io FULL JOIN (SELECT * FROM ir WHERE id % 7 = 0) n ON n.id = io.id", MEM, INDEX),
    "timeline": "SELECT conv_id, turn, substr(text, 1, 140) AS summary FROM conversations ORDER BY conv_id DESC, turn DESC LIMIT 10",
    "inspect_memory": sql("SELECT m.id, layer, status, round(act, 6) AS activation, coalesce(a.n, 0) AS edges_out, coalesce(b.n, 0) AS edges_in FROM mem m LEFT JOIN (SELECT src, count(*) AS n FROM ed GROUP BY src) a ON a.src = m.id LEFT JOIN (SELECT dst, count(*) AS n FROM ed GROUP BY dst) b ON b.dst = m.id", MEM, EDGES),
    "duplicate_ids": "SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1 HAVING count(*) > 1",
    "dangling_refs": sql("SELECT src, dst, type, 'src' AS missing FROM ed WHERE src NOT IN (SELECT id FROM mem WHERE status <> 'retired') UNION ALL SELECT src, dst, type, 'dst' FROM ed WHERE dst NOT IN (SELECT id FROM mem WHERE status <> 'retired')", MEM, EDGES),
    "range_violations": sql("SELECT count(*) FILTER (strength < 0 OR strength > 1) AS bad_strength, count(*) FILTER (storage < 0 OR storage > 1) AS bad_storage, count(*) FILTER (confidence < 1 OR confidence > 10) AS bad_confidence, count(*) FILTER (weight < 1 OR weight > 10) AS bad_weight, count(*) FILTER (frequency < 1) AS bad_frequency FROM mem", MEM),
    "temporal_consistency": sql("SELECT id, CAST(learned_at AS VARCHAR) AS learned_at, CAST(valid_from AS VARCHAR) AS valid_from FROM mem WHERE layer = 'raw' AND learned_at > valid_from", MEM),
    "next_sequence": "SELECT max(TRY_CAST(regexp_extract(c_name, '(\\d+)$', 1) AS BIGINT)) + 1 AS next FROM customer",
    "percentiles": "SELECT event_type, xs[1] AS p0, xs[CAST(ceil((len(xs) - 1) * CAST(0.5 AS DOUBLE)) AS BIGINT) + 1] AS p50, xs[CAST(ceil((len(xs) - 1) * CAST(0.95 AS DOUBLE)) AS BIGINT) + 1] AS p95, xs[len(xs)] AS p100 FROM (SELECT event_type, list_sort(list(value) FILTER (value IS NOT NULL)) AS xs FROM events GROUP BY event_type)",
    "chunk_layout": "SELECT chunk, count(*) AS n, min(id) AS first_id, max(id) AS last_id FROM (SELECT id, CASE WHEN i < total - 500 THEN i // 500 END AS chunk FROM (SELECT o_orderkey AS id, row_number() OVER (ORDER BY o_orderkey) - 1 AS i, count(*) OVER () AS total FROM orders)) GROUP BY chunk",
    "index_diff": sql("SELECT CASE WHEN a.id IS NULL THEN 'added' WHEN b.id IS NULL THEN 'removed' WHEN a.value <> b.value THEN 'updated' ELSE 'same' END AS action, count(*) AS n FROM lat a FULL JOIN cur b ON a.id = b.id GROUP BY 1", VERSIONS),
    "three_way_merge": sql("SELECT id, CASE WHEN ours THEN cv ELSE lv END AS value FROM (SELECT coalesce(l.id, c.id, s.id) AS id, l.value AS lv, c.value AS cv, l.id IS NOT NULL AS inl, s.id IS NOT NULL AND c.id IS NULL AS gone, c.id IS NOT NULL AND (s.id IS NULL OR c.value IS DISTINCT FROM s.value) AS ours FROM lat l FULL JOIN cur c ON l.id = c.id FULL JOIN snap s ON s.id = coalesce(l.id, c.id)) WHERE NOT gone AND (inl OR ours)", VERSIONS),
    "three_way_duplicates": sql("SELECT * FROM cur UNION ALL SELECT * FROM cur WHERE id % 70 = 1", VERSIONS),
    "chunk_rows": "SELECT id, CASE WHEN i < total - 500 THEN i // 500 END AS chunk FROM (SELECT o_orderkey AS id, row_number() OVER (ORDER BY o_orderkey) - 1 AS i, count(*) OVER () AS total FROM orders)",
    "chunk_writes": """WITH r AS (SELECT o_orderkey AS id, o_orderstatus AS value, row_number() OVER (ORDER BY o_orderkey) - 1 AS i, count(*) OVER () AS total FROM orders),
c AS (SELECT id, value, CASE WHEN i < total - 500 THEN lpad(CAST(i // 500 AS VARCHAR), 6, '0') ELSE 'hot' END AS chunk FROM r)
SELECT chunk, CASE WHEN chunk = '000002' THEN 'deleted' ELSE 'written' END AS action, CASE WHEN chunk = '000002' THEN 0 ELSE count(*) END AS n FROM c GROUP BY chunk HAVING chunk = '000002' OR count(*) FILTER (id % 4001 = 0) > 0""",
    "health": sql("SELECT count(*) AS rows, 0 AS no_id, count(*) FILTER (id % 50 = 3) AS no_statement, 0 AS odd_layer, count(*) FILTER (id % 40 = 7) AS odd_status, count(*) FILTER (layer = 'raw' AND valid_from < learned_at) AS early, 0 AS bad_strength, 0 AS bad_storage, 0 AS bad_confidence, 0 AS bad_weight, count(*) FILTER (frequency < 1) AS bad_frequency FROM mem", MEM),
    "overlay_merge": sql("SELECT m.id, round(coalesce(e.s, m.strength), 6) AS strength FROM mem m LEFT JOIN (SELECT user_id, arg_max(event_id % 100 / CAST(100 AS DOUBLE), (ts, event_id)) AS s FROM events GROUP BY user_id) e ON e.user_id = m.id", MEM),
    "adjacent_pairs": sql("SELECT conv_id, turn, \"user\", assistant FROM pairs", PAIRS),
    "greedy_clusters": sql("SELECT * FROM gc", greedy(0.35), recursive=True),
    "observation_match": sql("SELECT * FROM mt", SHARED, ENTITIES, f"cw AS (SELECT m.id AS seed, scope, domain, {token_set('statement')} AS w, tags, coalesce(en, []) AS entities FROM mem m LEFT JOIN en ON en.id = m.id WHERE layer = 'raw')", matched("cw", " WHERE NOT (c.seed % 4 = 0 AND o.observation = c.seed // 20 * 20 + 1)")),
    "observation_update": sql(
        """SELECT m.id, CAST(proof + coalesce(n, 0) AS BIGINT) AS proof, CAST(evidence + coalesce(n, 0) AS BIGINT) AS evidence, CAST(sources + coalesce(n, 0) AS BIGINT) AS sources, CAST(CASE WHEN n > 0 THEN least(10, floor((confidence * proof + c * n) / (proof + n) + 1)) ELSE confidence END AS BIGINT) AS confidence, CASE WHEN n >= 2 OR (n > 0 AND trend = 'new') THEN 'strengthening' ELSE trend END AS trend,
 round(greatest(strength, coalesce(s, 0)), 6) AS strength, round(greatest(storage, coalesce(g, 0)), 6) AS storage, CAST(frequency + coalesce(f, 0) AS BIGINT) AS frequency, CAST(turns + coalesce(t, 0) AS BIGINT) AS turns, CAST(greatest(weight, coalesce(w, 0)) AS BIGINT) AS weight, array_to_string(list_sort(list_distinct(list_concat(tags, coalesce(ta, [])))), ',') AS tags
 FROM mem m LEFT JOIN (SELECT id - id % 20 + 1 + id % 3 AS o, count(*) AS n, avg(confidence) AS c, max(strength) AS s, max(storage) AS g, sum(frequency) AS f, sum(turns) AS t, max(weight) AS w, flatten(list(tags)) AS ta FROM mem WHERE layer = 'raw' AND id % 20 < 9 AND id % 7 <> 0 GROUP BY 1) ON o = m.id WHERE layer = 'observation'""",
        MEM,
    ),
    "evolution_links": sql("SELECT a.id AS src, b.id AS dst FROM gr a JOIN gr b ON a.seed = b.seed AND a.id <> b.id WHERE a.seed IN (SELECT seed FROM bad)", MEM, GROUPED, BAD, recursive=True),
    "consolidate_pass": sql(
        "SELECT 'clusters' AS part, count(*) AS n, CAST(coalesce(sum(seed), 0) AS BIGINT) AS ids FROM gr UNION ALL SELECT 'evolution', count(*), CAST(coalesce(sum(b.id), 0) AS BIGINT) FROM gr a JOIN gr b ON a.seed = b.seed AND a.id <> b.id WHERE a.seed IN (SELECT seed FROM bad) UNION ALL SELECT 'merged', count(*), CAST(coalesce(sum(seed), 0) AS BIGINT) FROM cl WHERE seed NOT IN (SELECT seed FROM mt) UNION ALL SELECT 'marked', count(*), CAST(coalesce(sum(id), 0) AS BIGINT) FROM ok UNION ALL SELECT 'match', count(*), CAST(coalesce(sum(observation), 0) AS BIGINT) FROM mt UNION ALL SELECT 'updated', count(*), CAST(coalesce(sum(proof + n), 0) AS BIGINT) FROM (SELECT observation, count(*) AS n FROM ok JOIN mt USING (seed) GROUP BY observation) JOIN mem ON mem.id = observation UNION ALL SELECT 'sources', count(*), CAST(coalesce(sum(id), 0) AS BIGINT) FROM ok JOIN mt USING (seed)",
        SHARED, ENTITIES, GROUPED.replace("layer = 'raw'", "layer = 'raw' AND status = 'active' AND NOT consolidated"), BAD, "ok AS (SELECT * FROM gr WHERE seed NOT IN (SELECT seed FROM bad))",
        f"cl AS (SELECT seed, arg_min(scope, (learned_at, id)) AS scope, arg_min(domain, (learned_at, id)) AS domain, list_distinct(flatten(list({token_set('statement')}))) AS w, list_distinct(flatten(list(tags))) AS tags, list_distinct(flatten(list(coalesce(en, [])))) AS entities FROM ok LEFT JOIN en USING (id) GROUP BY seed)", matched("cl"), recursive=True,
    ),
    "stream_neighbours": "SELECT a.event_id AS src, b.event_id AS dst, round(1 - abs(epoch_us(CAST(a.ts AS TIMESTAMP)) - epoch_us(CAST(b.ts AS TIMESTAMP))) / CAST(7200000000 AS DOUBLE), 6) AS weight FROM events a JOIN events b ON a.user_id = b.user_id AND a.event_id < b.event_id AND abs(epoch_us(CAST(a.ts AS TIMESTAMP)) - epoch_us(CAST(b.ts AS TIMESTAMP))) <= 7200000000",
    "stream_feedback": "SELECT CAST(date_trunc('day', ts) - to_days(CAST(k AS INTEGER)) AS VARCHAR) AS start, user_id, count(*) AS negatives FROM events, range(30) r(k) WHERE event_type = 'error' GROUP BY ALL",
    "stream_sessions": "SELECT user_id, CAST(min(ts) AS VARCHAR) AS start, count(*) AS n FROM (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM (SELECT *, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) < 7200000000 THEN 0 ELSE 1 END AS fresh FROM events)) GROUP BY user_id, s",
    "stream_dedup": "SELECT DISTINCT 'sha256:' || sha256(user_id || '|' || event_type) AS hash FROM events",
    "stream_learn": "SELECT conv_id, turn, 'sha256:' || sha256(trim(regexp_replace(lower(text), '\\s+', ' ', 'g'))) AS hash, length(trim(text)) >= 8 AND NOT regexp_matches(trim(text), '[吧吗呢啊哦？?]$') AND NOT regexp_matches(trim(text), '[,，、…]$') AS passes FROM conversations WHERE role = 'user' AND trim(text) <> ''",
    "synthetic_store": "SELECT layer, scope, count(*) AS n, round(sum(CAST(0.2 AS DOUBLE) + i % 80 / CAST(100 AS DOUBLE)), 6) AS strength FROM (SELECT i, CASE WHEN i % 20 = 0 THEN 'mental_model' WHEN i % 20 <= 3 THEN 'observation' ELSE 'raw' END AS layer, 'project:' || i % 7 AS scope FROM range(10000) t(i)) GROUP BY ALL",
    "synthetic_edges": "SELECT i AS src, i - 1 AS dst, 'semantic' AS type, CAST(0.7 AS DOUBLE) AS weight FROM range(10000) t(i) WHERE i % 50 = 0 AND i > 0",
}
