"""The registered queries in SQL, for a second engine to run over the same tables."""

from __future__ import annotations

from dataclasses import replace

from sessionrec.operators.graph import RULES, Rule
from sessionrec.schema import DAY_MS

SQL: dict[str, str] = {}

USERS = """select cast(user_id as int) as session, cast(regexp_extract(props, '([0-9]+)', 1) as int) as aid, epoch_us(ts) // 1000 as ts,
  cast(case event_type when 'purchase' then 2 when 'signup' then 1 else 0 end as tinyint) as type from events"""
ORDERS = """select cast(o_custkey as int) as session, cast(l_partkey as int) as aid, epoch_us(l_shipdate) // 1000 as ts,
  cast(case l_returnflag when 'A' then 2 when 'R' then 1 else 0 end as tinyint) as type from lineitem join orders on l_orderkey = o_orderkey"""
NEWEST = "order by ts desc, aid desc, type desc"
A = "case type when 1 then 6.0::double when 2 then 3.0::double else 1.0::double end"
B = "case type when 1 then 3.0::double when 2 then 6.0::double else 1.0::double end"
TYPE_NAME = "case type when 0 then 'clicks' when 1 then 'carts' when 2 then 'orders' end"


def sql(*ctes: str, select: str) -> str:
    return "with " + ",\n".join(ctes) + "\n" + select


def ev(source: str, name: str = "ev") -> str:
    return f"{name} as ({source})"


def recent(n: int, of: str = "ev", name: str = "rc") -> str:
    return f"{name} as (select * exclude (rn) from (select *, row_number() over (partition by session {NEWEST}) as rn from {of}) where rn <= {n})"


def seeds(n: int = 20, of: str = "ev", name: str = "sd") -> str:
    return f"{name} as (select * from (select *, (row_number() over (partition by session {NEWEST}))::int as seed_rank from {of}) where seed_rank <= {n})"


def topk(of: str, group: str, score: str, k: int, tie: str, name: str) -> str:
    return f"{name} as (select * from (select *, (row_number() over (partition by {group} order by round({score}, 9) desc, {tie}))::int as rank from {of}) where rank <= {k})"


PAIRS = """pr as (select x.session, x.aid as aid_x, y.aid as aid_y, y.type as type_y, y.ts - x.ts as dt from rc x join rc y on x.session = y.session
  where x.aid <> y.aid and x.ts < y.ts)"""


def rule_pairs(rule: Rule, p: str, of: str = "ev") -> list[str]:
    """CTE {p}p: the rule's pairs. Types are chosen on each side first, and the sides are tables before they meet."""
    side = lambda name, types: f"{name} as materialized (select session, aid, ts, type from {p}r where type in ({', '.join(map(str, types))}))"
    return [
        recent(rule.max_events, of, f"{p}r") if rule.max_events else f"{p}r as (select * from {of})",
        side(f"{p}x", rule.sources),
        side(f"{p}y", rule.targets),
        f"""{p}p as (select x.session, x.aid as aid_x, y.aid as aid_y, y.type as type_y, y.ts - x.ts as dt from {p}x x join {p}y y on x.session = y.session
  where x.aid <> y.aid and y.ts > x.ts and y.ts - x.ts <= {rule.max_dt_ms})""",
    ]


def rule_edges(rule: Rule, p: str, of: str = "ev", by: str = "") -> list[str]:
    """CTE {p}e: the rule's edges (by bucket too, if asked for)."""
    bucket = "session % 16 as bucket, " if by else ""
    lead = "bucket, " if by else ""
    value = B.replace("case type", "case type_y")
    return [
        *rule_pairs(rule, p, of),
        f"{p}f as (select aid, count(*) as n from {of} group by aid)",
        f"{p}s as (select {bucket}aid_x, aid_y, sum({value} * ({rule.decay_seconds}::double / (dt::double / 1000 + {rule.decay_seconds}::double))) as mass from {p}p group by {lead}aid_x, aid_y)",
        f"""{p}e as (select {lead}aid_x, aid_y, mass * (1.0::double / pow(fx.n::double * fy.n::double, {rule.alpha}::double)) * {rule.weight}::double as weight, '{rule.name}' as graph
  from {p}s join {p}f fx on fx.aid = aid_x join {p}f fy on fy.aid = aid_y)""",
    ]


def three_graphs(of: str = "ev") -> list[str]:
    """CTE eg: the pruned edges of the three rules."""
    out = []
    for i, rule in enumerate(RULES):
        out += [*rule_edges(rule, f"g{i}", of), topk(f"g{i}e", "aid_x", "weight", rule.topk, "aid_y", f"g{i}k")]
    return [*out, "eg as (select * from g0k union all select * from g1k union all select * from g2k)"]


def popular(of: str, weight: str, k: int, name: str = "po") -> str:
    return f"""{name} as (select *, (row_number() over (order by score desc, aid))::int as rank from
  (select aid, sum({weight}) as score from {of} group by aid order by score desc, aid limit {k}))"""


CUT = f"mx as (select max(ts) - {DAY_MS} as cutoff from al)"
TRAIN = [ev(USERS, "al"), CUT, "ev as (select al.* from al, mx where ts < cutoff)"]
LABEL = "lb as (select al.* from al, mx where ts >= cutoff)"
TARGETS = """tg as (select session, aid, max((type = 0)::int)::tinyint as target_click, max((type = 1)::int)::tinyint as target_cart, max((type = 2)::int)::tinyint as target_order
  from lb group by session, aid)"""
GROUPED = """(select session, type, list(aid order by t, aid) as ground_truth from (select session, type, aid, min(ts) as t from {of} group by session, type, aid) group by session, type)"""


def candidates(k: int = 100, least: int = 50) -> list[str]:
    """CTE cd: candidates by the three graphs with the popular fallback."""
    return [
        *three_graphs(),
        seeds(),
        "s1 as (select session, aid, 60.0::double / seed_rank as score from sd union all select session, aid_y, weight from sd join eg on sd.aid = eg.aid_x)",
        "s2 as (select session, aid, sum(score) as score from s1 group by session, aid)",
        f"sp as (select session from s2 group by session having least(count(*), {k}) < {least})",
        popular("ev", B, k),
        "s3 as (select session, aid, sum(score) as score from (select * from s2 union all select session, aid, 0.6::double / rank from sp cross join po) group by session, aid)",
        topk("s3", "session", "score", k, "aid", "cd"),
    ]


SIGNALS = """gs as (select session, aid_y as aid, sum(weight) as graph_weight_sum, max(weight) as graph_weight_max, count(distinct graph)::int as graph_source_count,
  sum(case when graph = 'click_to_click' then weight else 0.0::double end) as graph_w_click_to_click,
  sum(case when graph = 'cart_order_to_cart_order' then weight else 0.0::double end) as graph_w_cart_order_to_cart_order,
  sum(case when graph = 'click_to_cart_order' then weight else 0.0::double end) as graph_w_click_to_cart_order
  from (select distinct session, aid from sd) join eg on aid = aid_x group by session, aid_y),
gd as (select *, (case when round(graph_w_click_to_cart_order, 9) >= round(graph_w_click_to_click, 9) and round(graph_w_click_to_cart_order, 9) >= round(graph_w_cart_order_to_cart_order, 9)
    and graph_w_click_to_cart_order > 0 then 3
  when round(graph_w_cart_order_to_cart_order, 9) >= round(graph_w_click_to_click, 9) and graph_w_cart_order_to_cart_order > 0 then 2
  when graph_w_click_to_click > 0 then 1 else 0 end)::tinyint as dominant_graph_source from gs)"""
LOCAL = """select session, aid, count(*)::int as local_interaction_count, (count(*) filter (where type = 0))::int as local_click_count, (count(*) filter (where type = 1))::int as local_cart_count,
  (count(*) filter (where type = 2))::int as local_order_count, max(ts) as item_last_ts from ev group by session, aid"""
FEATURES = [
    *TRAIN, *candidates(), SIGNALS, f"lo as ({LOCAL})", "sl as (select session, max(ts) as session_last_ts from ev group by session)",
    """fe as (select cd.session, cd.aid, cd.score as candidate_score, cd.rank as candidate_rank, coalesce(local_interaction_count, 0) as local_interaction_count,
  coalesce(local_click_count, 0) as local_click_count, coalesce(local_cart_count, 0) as local_cart_count, coalesce(local_order_count, 0) as local_order_count,
  (coalesce(local_interaction_count, 0) > 0)::tinyint as is_repeated_item, session_last_ts, item_last_ts, session_last_ts - item_last_ts as delta_t_nan,
  coalesce(session_last_ts - item_last_ts, 9999999) as delta_t_filled, coalesce(graph_weight_sum, 0) as graph_weight_sum, coalesce(graph_weight_max, 0) as graph_weight_max,
  coalesce(graph_source_count, 0) as graph_source_count, coalesce(graph_w_click_to_click, 0) as graph_w_click_to_click,
  coalesce(graph_w_cart_order_to_cart_order, 0) as graph_w_cart_order_to_cart_order, coalesce(graph_w_click_to_cart_order, 0) as graph_w_click_to_cart_order,
  coalesce(graph_weight_sum, 0) as graph_weight_total, coalesce(dominant_graph_source, 0::tinyint) as dominant_graph_source
  from cd left join lo using (session, aid) left join sl using (session) left join gd using (session, aid))""",
]
LABELLED = [*FEATURES, LABEL, TARGETS, """la as (select fe.*, coalesce(target_click, 0::tinyint) as target_click, coalesce(target_cart, 0::tinyint) as target_cart, coalesce(target_order, 0::tinyint) as target_order
  from fe left join tg using (session, aid))"""]
POOL_LABELLED = [*TRAIN, *candidates(), LABEL, TARGETS, """la as (select cd.*, coalesce(target_click, 0::tinyint) as target_click, coalesce(target_cart, 0::tinyint) as target_cart,
  coalesce(target_order, 0::tinyint) as target_order from cd left join tg using (session, aid))"""]


def negative(target: str) -> list[str]:
    g = "graph_w_cart_order_to_cart_order"
    return [*LABELLED, f"th as (select coalesce(quantile_disc(round({g}, 9), 0.8), 0.0) as t from la where {target} = 0 and {g} > 0)",
        f"""nb as (select la.*, case when {target} = 1 then 'positive' when round({g}, 9) > 0 and round({g}, 9) >= t then 'hard_graph' when local_click_count >= 2 then 'hard_click' else 'random' end as negative_bucket
  from la, th)"""]  # fmt: skip


def tail(of: str, held: int) -> list[str]:
    """CTEs tr (train events) and ht (held events)."""
    return [f"tt as (select *, row_number() over (partition by session {NEWEST}) as pos, count(*) over (partition by session) as len from {of})",
        f"tr as (select session, aid, ts, type from tt where not (len >= 2 and pos <= {held}))", f"ht as (select session, aid, ts, type from tt where len >= 2 and pos <= {held})",
        f"gl as {GROUPED.format(of='ht')}"]


def single_graph(of: str = "tr", k: int = 20) -> list[str]:
    """CTE cs: candidates by the single graph over the train side of the tail split."""
    w = A.replace("case type", "case type_y")
    return [recent(30, of), PAIRS, f"ce as (select aid_x, aid_y, sum({w} * (1.0::double / (1.0::double + dt::double / 86400000.0::double))) as weight from pr group by aid_x, aid_y)",
        topk("ce", "aid_x", "weight", 20, "aid_y", "ck"), seeds(20, of),
        "u1 as (select session, aid, 50.0::double / seed_rank as score from sd union all select session, aid_y, weight from sd join ck on sd.aid = ck.aid_x)",
        "u2 as (select session, aid, sum(score) as score from u1 group by session, aid)", topk("u2", "session", "score", k, "aid", "cs")]


U, O = ev(USERS), ev(ORDERS)
TAIL3 = [U, *tail("ev", 3)]
ALL = "select session, aid, ts, type from "

SQL["read_session_json"] = sql(U, select=ALL + "ev")
SQL["limit_sessions"] = sql(O, select=ALL + "ev where session in (select distinct session from ev order by session limit 100)")
SQL["encode_event_type"] = sql(U, select=f"select session, ts, {TYPE_NAME} as name, type from ev")
SQL["normalize_events"] = SQL["read_events"] = SQL["compact_to_parquet"] = sql(O, select=ALL + "ev")
SQL["write_events"] = sql(U, select=ALL + "ev")
SQL["write_session_buckets"] = sql(O, select="select (session % 16)::int as bucket, count(*) as rows, sum(aid)::bigint as aids from ev group by all")
SQL["bucket_stats"] = sql(U, *rule_edges(RULES[0], "g", by="bucket"), topk("ge", "bucket, aid_x", "weight", 5, "aid_y", "gk"),
    "a as (select session % 16 as bucket, count(*) as rows_in from gr group by all)", "b as (select bucket, count(*) as rows_built from ge group by all)", "c as (select bucket, count(*) as rows_pruned from gk group by all)",
    select="select 'click_to_click' as graph, bucket::int as bucket, coalesce(rows_in, 0) as rows_in, coalesce(rows_built, 0) as rows_built, coalesce(rows_pruned, 0) as rows_pruned from a full join b using (bucket) full join c using (bucket)")
SQL["event_weight"] = sql(U, select=f"select session, sum({A}) as weight from ev group by session")
SQL["target_value"] = sql(U, select=f"select session, sum({B}) as weight from ev group by session")
SQL["time_decay_rational"] = sql(U, recent(30), PAIRS, select="select aid_x, round(sum(21600.0::double / (dt::double / 1000 + 21600.0::double)), 6) as decay from pr group by aid_x")
SQL["time_decay_daily"] = sql(U, recent(30), PAIRS, select="select aid_x, round(sum(1.0::double / (1.0::double + dt::double / 86400000.0::double)), 6) as decay from pr group by aid_x")
SQL["degree_penalty"] = sql(O, select="select aid, count(*) as item_freq, round(1.0::double / pow(count(*)::double * (count(*) + 1)::double, 0.5::double), 6) as penalty from ev group by aid")
SQL["smoothed_rate"] = sql(O, "i as (select aid, (count(*) filter (where type = 0))::double as c, (count(*) filter (where type = 2))::double as b from ev group by aid)", "p as (select sum(b) / sum(c) as prior from i)",
    select="select aid, round((b + 50 * prior) / (c + 50), 6) as rate from i, p")
SQL["session_holdout"] = sql(O, select="select case when session % 10 = 0 then 'eval' else 'train' end as side, session, count(*) as rows from ev group by all")
SQL["session_pairs"] = sql(U, recent(30), PAIRS, select="select * from pr")
SQL["session_pairs_windowed"] = sql(O, *rule_pairs(RULES[2], "g"), select="select * from gp")
SQL["session_pairs_banded"] = sql(O, *rule_pairs(replace(RULES[2], max_events=0), "g"), select="select * from gp")
SQL["attach_degree_penalty"] = sql(O, *rule_pairs(RULES[1], "g"), "f as (select aid, count(*) as n from ev group by aid)", "q as (select aid_x, aid_y, count(*) as pairs from gp group by all)",
    select="select aid_x, aid_y, pairs, x.n as freq_x, y.n as freq_y, round(1.0::double / pow(x.n::double * y.n::double, 0.5::double), 6) as penalty from q join f x on x.aid = aid_x join f y on y.aid = aid_y")
SQL["expand_seeds"] = sql(U, *three_graphs(), seeds(), select="select session, aid_y as aid, graph, count(*) as times, round(sum(weight), 6) as weight from sd join eg on sd.aid = eg.aid_x group by all")
SQL["fallback_cross"] = sql(O, popular("ev", B, 20), select="select session, aid, round(0.6::double / rank, 6) as score from (select distinct session from ev) cross join po")
SQL["events_for_candidates"] = sql(*TRAIN, *candidates(), select=ALL + "ev where (session, aid) in (select (session, aid) from cd)")
SQL["graph_signals_for_candidates"] = sql(*TRAIN, *candidates(), SIGNALS,
    select="select session, aid, graph_source_count, dominant_graph_source, round(graph_weight_sum, 6) as graph_weight_sum, round(graph_weight_max, 6) as graph_weight_max from gd where (session, aid) in (select (session, aid) from cd)")
COUNTS = "count(*) as total_interactions, count(*) filter (where type = 0) as click_count, count(*) filter (where type = 1) as cart_count, count(*) filter (where type = 2) as order_count"
ITEMS = [f"ic as (select aid, {COUNTS}, count(*) filter (where ts >= (select max(ts) - {DAY_MS} from ev)) as recent_24h_interactions from ev group by aid)",
    "it as (select sum(click_count)::double as c, sum(cart_count)::double as a, sum(order_count)::double as o from ic)",
    """fi as (select ic.*, (cart_count + order_count + 50 * ((a + o) / greatest(c, 1))) / (click_count + 50) as conversion_rate, (cart_count + 50 * (a / greatest(c, 1))) / (click_count + 50) as item_cart_conversion_rate,
  (order_count + 50 * (o / greatest(c, 1))) / (click_count + 50) as item_buy_conversion_rate, (order_count + 50 * (o / greatest(a, 1))) / (cart_count + 50) as item_cart_to_order_rate from ic, it)"""]  # fmt: skip
SQL["attach_item_features"] = sql(*TRAIN, *candidates(), *ITEMS, select="select cd.session, cd.aid, total_interactions, order_count, round(item_buy_conversion_rate, 6) as item_buy_conversion_rate from cd left join fi using (aid)")
SQL["label_candidates"] = sql(*POOL_LABELLED, select="select session, aid, target_click, target_cart, target_order from la")
SQL["item_frequency"] = sql(O, select="select aid, count(*) as item_freq from ev group by aid")
SQL["merge_edges"] = sql(U, *rule_edges(RULES[1], "g"), topk("ge", "aid_x", "weight", 20, "aid_y", "gk"), select="select graph, aid_x, aid_y, rank, round(weight, 6) as weight from gk")
SQL["local_item_stats"] = sql(O, select=LOCAL)
SQL["session_last_ts"] = sql(O, select="select session, max(ts) as session_last_ts from ev group by session")
ROUNDED = ", ".join(f"round({c}, 6) as {c}" for c in ("graph_weight_sum", "graph_weight_max", "graph_w_click_to_click", "graph_w_cart_order_to_cart_order", "graph_w_click_to_cart_order"))
SQL["graph_signal_features"] = sql(*TRAIN, *three_graphs(), seeds(), SIGNALS, select=f"select session, aid, graph_source_count, dominant_graph_source, {ROUNDED} from gd")
SQL["candidate_pool_summary"] = sql(*TRAIN, *candidates(), "n as (select count(*) as n from cd group by session)",
    select="""select count(*) as sessions, min(n) as min_candidates, avg(n) as mean_candidates, median(n) as median_candidates, max(n) as max_candidates,
  count(*) filter (where n >= 50) as sessions_ge_min, count(*) filter (where n = 100) as sessions_full from n""")  # fmt: skip
SQL["graph_weight_threshold"] = sql(*negative("target_order"), select="select round(t, 6) as threshold from th")
SQL["negative_bucket_counts"] = sql(*negative("target_order"), select="select negative_bucket, count(*) as rows from nb group by all")
SQL["label_stats"] = sql(*POOL_LABELLED, select="select (session % 4)::int as bucket, count(*) as rows, sum(target_click)::bigint as target_click, sum(target_cart)::bigint as target_cart, sum(target_order)::bigint as target_order from la group by rollup (session % 4)")
SQL["prune_topk"] = sql(O, f"s as (select session, aid, sum({A}) as score from ev group by all)", topk("s", "session", "score", 5, "aid", "k"), select="select session, aid, score, rank from k")
SQL["recent_session_events"] = sql(O, recent(30), select=ALL + "rc")
SQL["split_tail"] = sql(O, *tail("ev", 1), "n as (select session, count(*) as train_events from tr group by session)",
    select="select session, train_events, type, array_to_string(ground_truth, ' ') as ground_truth from n full join gl using (session)")
SQL["recent_seeds"] = sql(O, seeds(), select="select session, aid, ts, type, seed_rank from sd")
SQL["recent_seed_items"] = sql(O, seeds(), select="select distinct session, aid from sd")
SQL["recent_unique_items"] = sql(O, "l as (select session, aid, max(ts) as t from ev group by all)", "p as (select session, aid, (row_number() over (partition by session order by t desc, aid desc))::int as pos from l)", select="select * from p where pos <= 20")
SQL["heavy_items"] = SQL["popular_items"] = sql(O, popular("ev", A, 100), select="select aid, score, rank from po")
SQL["popular_fallback_items"] = sql(O, popular("ev", B, 100), select="select aid, score, rank from po")
SQL["union_candidates"] = sql(U, *three_graphs(), seeds(), "s1 as (select session, aid, 60.0::double / seed_rank as score from sd union all select session, aid_y, weight from sd join eg on sd.aid = eg.aid_x)",
    select="select session, aid, round(sum(score), 6) as score from s1 group by all")
SQL["union_graphs"] = sql(U, *[c for i, r in enumerate(RULES) for c in rule_edges(r, f"g{i}")], select="select graph, count(*) as edges, round(sum(weight), 4) as weight from (select graph, weight from g0e union all select graph, weight from g1e union all select graph, weight from g2e) group by graph")
SQL["with_total_row"] = sql(U, select="select (session % 8)::varchar as part, count(*) as rows, count(distinct session) as sessions from ev group by all union all select '__TOTAL__', count(*), null from ev")
SQL["explode_labels"] = sql(*TAIL3, select="select session, type, unnest(ground_truth) as aid from gl")
SQL["parse_labels"] = sql(*TAIL3, select="select session, type, len(ground_truth)::int as n, array_to_string(ground_truth, ',') as items from gl")
LISTS = "ls as (select session, list(aid order by rank) as labels from cs group by session)"
NAMES = "(values ('clicks'), ('carts'), ('orders')) n(name)"
SQL["format_submission"] = sql(*TAIL3, *single_graph(), LISTS, select=f"select session || '_' || name as session_type, array_to_string(labels, ' ') as labels from ls cross join {NAMES}")
SQL["predictions_for_metric"] = sql(*TAIL3, *single_graph(), LISTS, select=f"select session, name as type, array_to_string(labels, ',') as labels from ls cross join {NAMES}")
SQL["covisitation_edges"] = sql(U, *single_graph("ev")[:3], select="select aid_x, aid_y, round(weight, 6) as weight from ce")
for _rule in RULES:
    SQL[f"rule_edges_{_rule.name}"] = sql(O, *rule_edges(_rule, "g"), select="select aid_x, aid_y, graph, round(weight, 6) as weight from ge")
SQL["rule_edges_whole_sessions"] = sql(O, *rule_edges(replace(RULES[2], max_events=0), "g"), select="select aid_x, aid_y, graph, round(weight, 6) as weight from ge")
SQL["rule_graph_topk"] = sql(U, *three_graphs(), select="select aid_x, aid_y, graph, rank, round(weight, 6) as weight from eg")
SQL["rule_graph_incremental"] = SQL["rule_graph_topk"]


def update_report(n: int = 3) -> str:
    """After each stretch of time: its events and sessions, earlier events of those sessions, and all pairs so far."""
    ctes = [U, "en as (select min(ts) as lo, max(ts) as hi from ev)", f"bt as (select ev.*, ((ts - lo) * {n}) // (hi - lo + 1) as batch from ev, en)"]
    parts = []
    for k in range(n):
        ctes.append(f"e{k} as (select session, aid, ts, type from bt where batch <= {k})")
        for i, rule in enumerate(RULES):
            ctes += rule_pairs(rule, f"h{k}{i}", f"e{k}")
        pairs = " + ".join(f"(select count(*) from (select distinct aid_x, aid_y from h{k}{i}p))" for i in range(len(RULES)))
        parts.append(f"""select {k} as batch, (select count(*) from bt where batch = {k}) as new_events, (select count(distinct session) from bt where batch = {k}) as sessions,
  (select count(*) from bt where batch < {k} and session in (select session from bt where batch = {k})) as old_events, {pairs} as all_pairs""")
    return sql(*ctes, select=" union all ".join(parts))


SQL["rule_graph_update_report"] = update_report()
SQL["flagship_click_graph"] = sql(U, *rule_edges(RULES[0], "g"), topk("ge", "aid_x", "weight", 20, "aid_y", "gk"), select="select aid_x, aid_y, rank, round(weight, 6) as weight from gk")
SQL["graph_topk_bucketed"] = sql(U, *rule_edges(RULES[1], "g", by="bucket"), topk("ge", "bucket, aid_x", "weight", 80, "aid_y", "gp2"), "gm as (select aid_x, aid_y, sum(weight) as weight from gp2 group by all)",
    topk("gm", "aid_x", "weight", 20, "aid_y", "gk"), select="select aid_x, aid_y, rank, round(weight, 6) as weight from gk")
UNDIRECTED = [recent(30), "di as (select distinct session, aid from rc)", "ud as (select x.aid as aid_x, y.aid as aid_y, count(*) as weight from di x join di y on x.session = y.session and x.aid <> y.aid group by all)", topk("ud", "aid_x", "weight", 40, "aid_y", "uk")]
SQL["undirected_covisitation"] = sql(U, *UNDIRECTED, select="select aid_x, aid_y, weight, rank from uk")
SQL["recommend_from_edges"] = sql(*TAIL3, *single_graph(), select="select session, aid, rank, round(score, 6) as score from cs")
SQL["recommend_from_graphs"] = sql(*TRAIN, *candidates(), select="select session, aid, rank, round(score, 6) as score from cd")
SQL["recommend_mixed"] = sql(U, *UNDIRECTED, popular("ev", A, 20), "l as (select session, aid, max(ts) as t from ev group by all)",
    "p as (select * from (select session, aid, row_number() over (partition by session order by t desc, aid desc) as pos from l) where pos <= 20)",
    "m as (select session, aid, 0 as g, 0 as a, pos as b from p union all select session, aid_y, 1, pos, rank from p join uk on p.aid = uk.aid_x union all select session, po.aid, 2, 0, rank from (select distinct session from ev) cross join po)",
    "f as (select session, aid, min((g, a, b)) as place from m group by all)", "o as (select session, aid, (row_number() over (partition by session order by place))::int as rank from f)", select="select * from o where rank <= 20")
SQL["split_time_axis"] = sql(*TRAIN, LABEL, f"gl as {GROUPED.format(of='lb')}", "n as (select session, count(*) as feature_events from ev group by session)",
    select="select session, feature_events, type, array_to_string(ground_truth, ' ') as ground_truth from n full join gl using (session)")
SQL["label_targets"] = sql(*TRAIN, LABEL, TARGETS, select="select * from tg")
SIDE = "count(*) as {0}_events, count(distinct session) as {0}_sessions, min(ts) as {0}_min_ts, max(ts) as {0}_max_ts"
SQL["split_audit"] = sql(*TRAIN, LABEL, TARGETS, f"a as (select {SIDE.format('feature')} from ev)", f"b as (select {SIDE.format('label')} from lb)",
    "c as (select count(*) as targets, sum(target_click)::bigint as target_click, sum(target_cart)::bigint as target_cart, sum(target_order)::bigint as target_order from tg)",
    "d as (select count(*) as both_sides, count(*) filter (where x < y) as strict_ok, count(*) filter (where x >= y) as violations from (select session, max(ts) as x from ev group by session) join (select session, min(ts) as y from lb group by session) using (session))",
    select="select * from a, b, c, d")
SQL["recall_at_k_capped"] = sql(*TAIL3, *single_graph(), LISTS,
    "h as (select type, sum(coalesce(len(list_intersect(ground_truth, labels)), 0))::double as hits, sum(least(len(ground_truth), 20))::double as total from gl left join ls using (session) group by type)",
    select="select round(sum(w * hits / total) / sum(w), 6) as weighted_recall from (select *, case type when 0 then 0.1::double when 1 then 0.3::double else 0.6::double end as w from h)")


def recall(labels: str, cands: str, k: int) -> list[str]:
    return [f"le as (select session, type, unnest(ground_truth) as aid from {labels})", f"rb as (select distinct session, aid from {cands} where rank <= {k})",
        "rt as (select type, count(*) as total, count(rb.aid) as hits from le left join rb using (session, aid) group by type)",
        "rr as (select *, hits::double / total as recall, case type when 0 then 0.1::double when 1 then 0.3::double when 2 then 0.6::double else 0.0::double end as metric_weight from rt)"]


SQL["recall_at_k"] = sql(*TAIL3, *single_graph(), *recall("gl", "cs", 20),
    select="select type, total, hits, round(recall, 6) as recall, round(metric_weight, 6) as metric_weight, round((select sum(recall * metric_weight) / sum(metric_weight) from rr), 6) as weighted_recall from rr")
SQL["candidate_coverage"] = sql(*POOL_LABELLED, f"gl as {GROUPED.format(of='lb')}", *recall("gl", "cd", 100),
    "z as (select 0::tinyint as type, sum(target_click)::bigint as positives, count(*) - sum(target_click) as negatives from la union all select 1::tinyint, sum(target_cart)::bigint, count(*) - sum(target_cart) from la union all select 2::tinyint, sum(target_order)::bigint, count(*) - sum(target_order) from la)",
    select="select type, positives, negatives::bigint as negatives, round(case when positives > 0 then negatives::double / positives end, 6) as neg_per_pos, round(recall, 6) as recall from z left join rr using (type)")
SQL["item_features"] = sql(O, *ITEMS, select="""select aid, total_interactions, click_count, cart_count, order_count, recent_24h_interactions, round(conversion_rate, 6) as conversion_rate, round(item_cart_conversion_rate, 6) as item_cart_conversion_rate,
  round(item_buy_conversion_rate, 6) as item_buy_conversion_rate, round(item_cart_to_order_rate, 6) as item_cart_to_order_rate, round(least(1, greatest(0, 1 - item_cart_to_order_rate)), 6) as item_funnel_dropoff_rate from fi""")  # fmt: skip


def visits(source: str, gap: int) -> str:
    """Visits begin where the event before is more than the gap away."""
    return sql(ev(source), f"vs as (select *, case when ts - lag(ts) over (partition by session order by ts) <= {gap} then 0 else 1 end as starts from ev)",
        "vn as (select *, sum(starts) over (partition by session order by ts range between unbounded preceding and current row) as visit from vs)",
        select="""select session, count(*) as visit_length, count(distinct aid) as unique_items, min(ts) as first_ts, max(ts) as last_ts, count(*) filter (where type = 1) as cart_count,
  count(*) filter (where type = 2) as order_count, max(ts) - min(ts) as duration,
  (count(*) >= 50 and count(*) filter (where type = 1) = 0 and count(*) filter (where type = 2) = 0)::tinyint as is_window_shopping from vn group by session, visit""")  # fmt: skip


SQL["visit_features"] = visits(ORDERS, 7 * DAY_MS)
SQL["visit_features_stream"] = visits(USERS, DAY_MS)
SQL["session_features"] = sql(O, "s as (select session, count(*) as session_length, count(distinct aid) as unique_items, min(ts) as first_ts, max(ts) as last_ts, count(*) filter (where type = 1) as cart_count, count(*) filter (where type = 2) as order_count from ev group by session)",
    select="select *, last_ts - first_ts as duration, (session_length >= 50 and cart_count = 0 and order_count = 0)::tinyint as is_window_shopping from s")
SQL["interaction_features"] = sql(*FEATURES, select=f"select * exclude (candidate_score, graph_weight_total, graph_weight_sum, graph_weight_max, graph_w_click_to_click, graph_w_cart_order_to_cart_order, graph_w_click_to_cart_order), round(candidate_score, 6) as candidate_score, round(graph_weight_total, 6) as graph_weight_total, {ROUNDED} from fe")
SQL["negative_bucket"] = sql(*negative("target_click"), select="select session, aid, negative_bucket from nb")
SQL["sampling_thresholds"] = sql(*negative("target_click"), "k as (select negative_bucket, count(*) as n from nb group by all)", "q as (select coalesce(sum(n) filter (where negative_bucket = 'positive'), 0) as p from k)",
    select="select negative_bucket, (case when negative_bucket = 'positive' then 1000000 else floor(least(1, floor(p * case when negative_bucket = 'random' then 4 else 8 end)::double / greatest(n, 1)) * 1000000) end)::bigint as \"limit\" from k, q")
KINDS = ", ".join(f"count(*) filter (where negative_bucket = '{b}') as {b}" for b in ("positive", "hard_graph", "hard_click", "random"))
SQL["hard_negative_report"] = sql(*negative("target_click"), select=f"""select (session % 4)::varchar as part, count(*) as rows, {KINDS}, null::double as neg_per_pos from nb group by session % 4
  union all select '__TOTAL__', count(*), {KINDS}, round(case when count(*) filter (where negative_bucket = 'positive') > 0 then (count(*) - count(*) filter (where negative_bucket = 'positive'))::double / count(*) filter (where negative_bucket = 'positive') end, 6) from nb""")  # fmt: skip
SQL["ranker_training_frame"] = sql(*LABELLED, select="select session, aid, target_click, (delta_t_nan is not null)::double as delta_t_known, delta_t_filled::double as delta_t_filled, round(candidate_score, 6) as candidate_score, round(graph_weight_total, 6) as graph_weight_total from la where session % 10 <> 0")
SQL["ranked_hit_recall"] = sql(*POOL_LABELLED, "b as (select *, row_number() over (partition by session order by round(score, 9) desc, aid) as r from la)",
    select="select count(*) as rows, count(distinct session) as sessions, sum(target_click)::bigint as positives, count(*) filter (where r <= 20) as top_rows, (sum(target_click) filter (where r <= 20))::bigint as hits, round(case when sum(target_click) > 0 then (sum(target_click) filter (where r <= 20))::double / sum(target_click) else 0 end, 6) as recall from b")


def draw(*keys: str, seed: int = 42) -> str:
    return f"(('0x' || substr(md5(concat_ws('/', {', '.join(keys)}, '{seed}')), 1, 13))::ubigint % 1000000)"


SQL["hash_sample_filter"] = sql(O, select=f"{ALL}ev where {draw('session', 'aid')} < 250000")
SQL["sample_sessions"] = sql(O, "d as (select session from (select distinct session from ev) order by md5(concat_ws('/', session, '42')), session limit 200)", select=ALL + "ev where session in (select session from d)")
SQL["downsample_negatives"] = sql(*POOL_LABELLED, "c as (select count(*) filter (where target_click = 1) as p, count(*) filter (where target_click <> 1) as n from la)",
    select=f"select session, aid, target_click from la, c where target_click = 1 or {draw('session', 'aid')} < floor(least(1.0::double, 20.0::double * p / greatest(n, 1)) * 1000000)")
SQL["sample_hard_negatives"] = sql(*negative("target_click"), *ITEMS, "k as (select negative_bucket, count(*) as n from nb group by all)", "q as (select coalesce(sum(n) filter (where negative_bucket = 'positive'), 0) as p from k)",
    "l as (select negative_bucket, case when negative_bucket = 'positive' then 1000000 else floor(least(1, floor(p * case when negative_bucket = 'random' then 4 else 8 end)::double / greatest(n, 1)) * 1000000) end as most from k, q)",
    select=f"select session, nb.aid, negative_bucket, total_interactions from nb join l using (negative_bucket) left join fi on nb.aid = fi.aid where {draw('session', 'nb.aid', 'negative_bucket')} < most")
SAMPLED = [*negative("target_click"), "k as (select negative_bucket, count(*) as n from nb group by all)", "q as (select coalesce(sum(n) filter (where negative_bucket = 'positive'), 0) as p from k)",
    "l as (select negative_bucket, (case when negative_bucket = 'positive' then 1000000 else floor(least(1, floor(p * case when negative_bucket = 'random' then 4 else 8 end)::double / greatest(n, 1)) * 1000000) end)::bigint as most from k, q)",
    f"sm as (select session, aid, negative_bucket from nb join l using (negative_bucket) where {draw('session', 'aid', 'negative_bucket')} < most)",
    "pt as (select (session % 4)::varchar as part, negative_bucket as b from sm union all select '__TOTAL__', negative_bucket from sm)"]
SQL["write_hard_negatives"] = sql(*SAMPLED, select="select part, " + ", ".join(f"coalesce((select most from l where negative_bucket = '{k}'), 0) as threshold_{k}" for k in ("hard_click", "hard_graph", "random")) + ", "
    + ", ".join(f"count(*) filter (where b = '{k}') as {k}_rows" for k in ("positive", "hard_click", "hard_graph", "random"))
    + """, count(*) as rows, count(*) filter (where b <> 'positive') as negative_rows, round((select max(t) from th), 6) as graph_threshold,
  round(case when count(*) filter (where b = 'positive') > 0 then (count(*) filter (where b <> 'positive'))::double / count(*) filter (where b = 'positive') end, 6) as neg_pos_ratio from pt group by part""")  # fmt: skip
SQL["write_interaction_features"] = sql(*FEATURES, select="""select (session % 8)::int as bucket, count(*) as rows, sum(aid)::bigint as aids, sum(local_interaction_count)::bigint as interactions, sum(dominant_graph_source)::bigint as dominant
  from fe group by session % 8""")  # fmt: skip
