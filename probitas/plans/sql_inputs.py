"""DuckDB SQL mirrors of ``probitas.sources.driver_tables`` (for the oracle).

Each function returns CTE text ``name AS (...)``; ``with_inputs`` stitches the
ones a query needs in front of it.
"""

from __future__ import annotations

from probitas import rules as R
from probitas.functions.numeric import AS_A, AS_P
from probitas.sources import driver_tables as D


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def lst(values) -> str:
    return "[" + ", ".join(q(v) if isinstance(v, str) else str(v) for v in values) + "]"


def pick(values, idx_sql: str) -> str:
    return f"{lst(values)}[CAST(({idx_sql}) % {len(values)} AS INTEGER) + 1]"


def npr(expr: str, digits: int) -> str:
    scale = float(10 ** digits)
    return f"(round_even(({expr}) * {scale}, 0) / {scale})"


def stable(expr: str, digits: int) -> str:
    return npr(npr(expr, 10), digits)


def stable_py(expr: str, digits: int) -> str:
    """Python's ``round`` of the snapped value: its exact decimal expansion against the tie between the two candidates."""
    scale = 10 ** digits
    k = f"CAST(floor(abs(v) * {scale}) AS BIGINT)"
    exact = "CAST(printf('%.35f', abs(v)) AS DECIMAL(38, 30))"
    tie = f"CAST(printf('%d.%0{digits + 1}d', ((2 * {k} + 1) * 5) // {10 * scale}, ((2 * {k} + 1) * 5) % {10 * scale}) AS DECIMAL(38, 30))"
    return (f"list_transform([{npr(expr, 10)}], lambda v: sign(v) * ({k} + CASE WHEN {exact} > {tie} "
            f"OR ({exact} = {tie} AND {k} % 2 = 1) THEN 1 ELSE 0 END) / {float(scale)})[1]")


def erfc_sql(x: str) -> str:
    t = f"(1.0 / (1.0 + {AS_P} * ({x})))"
    a1, a2, a3, a4, a5 = AS_A
    return f"(({t} * ({a1} + {t} * ({a2} + {t} * ({a3} + {t} * ({a4} + {t} * {a5}))))) * exp(-(({x}) * ({x}))))"


N_GROUPS = f"(SELECT greatest(1, count(*) // {D.SUPPLIERS_PER_GROUP}) FROM supplier)"


def of_group(values: list, idx: str, sep: str = "") -> str:
    n = len(values)
    return f"({pick(values, idx)} || CASE WHEN ({idx}) // {n} > 0 THEN {q(sep)} || CAST(({idx}) // {n} AS VARCHAR) ELSE '' END)"


def cte_countries() -> str:
    names = [c[1] for c in D.COUNTRY_FIXTURE]
    cits = [c[2] for c in D.COUNTRY_FIXTURE]
    langs = "[" + ", ".join(lst([l for l, _ in c[3]]) for c in D.COUNTRY_FIXTURE) + "]"
    codes = "[" + ", ".join(lst([k for _, k in c[3]]) for c in D.COUNTRY_FIXTURE) + "]"
    i = "CAST(r_regionkey % 5 AS INTEGER) + 1"
    at = "(CAST(r_regionkey % 5 AS BIGINT) + 5 * g)"
    return f"""countries AS (
  SELECT {of_group(D.COUNTRY_IDS, at)} AS country_id, {of_group(names, at, ' ')} AS country, {lst(cits)}[{i}] AS citizenship,
         {langs}[{i}] AS languages, {codes}[{i}] AS language_codes, CAST(r_regionkey + 5 * g AS INTEGER) AS ord
  FROM (SELECT *, unnest(range(0, {N_GROUPS})) AS g FROM region))"""


def cte_pairs() -> str:
    return """pairs AS (
  SELECT country_id, country, ord AS country_ord, CAST(pos - 1 AS INTEGER) AS lang_pos,
         languages[pos] AS language, language_codes[pos] AS language_code
  FROM (SELECT *, unnest(generate_series(1, len(languages))) AS pos FROM countries))"""


def unit_key_sql(s="scenario", lc="language_code", cid="country_id") -> str:
    return (f"CASE WHEN {s} = {q(R.SCENARIO_LANGUAGE)} THEN {lc} WHEN {s} = {q(R.SCENARIO_COUNTRY)} THEN {cid} "
            f"ELSE concat_ws('_', {lc}, {cid}) END")


def cte_units(models=None) -> str:
    models = models or R.MODEL_LIST
    return f"""units AS (
  SELECT scenario, model, {unit_key_sql()} AS unit_key, country_id, country, language, language_code,
         country_ord, lang_pos
  FROM (SELECT *, unnest({lst(R.SCENARIOS)}) AS scenario FROM pairs) s,
       (SELECT unnest({lst(models)}) AS model) m)"""


def cte_item_scores(n: int = R.TEST_RULES.n_criteria) -> str:
    sc = pick(R.SCENARIOS, "l_linenumber")
    uk = {R.SCENARIO_LANGUAGE: pick(D.LANGUAGE_CODES, "l_orderkey"),
          R.SCENARIO_COUNTRY: of_group(D.COUNTRY_IDS, f"(l_orderkey % ({D.N_COUNTRIES} * {N_GROUPS}))"),
          R.SCENARIO_LANGUAGE_COUNTRY: of_group(D.PAIR_KEYS, f"(l_orderkey % ({len(D.PAIR_KEYS)} * {N_GROUPS}))")}
    p = "(l_discount * 10)"
    qq = "(l_quantity / 50.0)"
    fval = npr("(l_partkey % 6) / 5.0", 2)
    sval = npr("(l_suppkey % 6) / 5.0", 2)
    return f"""li_keyed AS (
  SELECT scenario, {pick(D.TEST_MODELS, 'l_suppkey')} AS model,
         CASE WHEN scenario = {q(R.SCENARIO_LANGUAGE)} THEN {uk[R.SCENARIO_LANGUAGE]}
              WHEN scenario = {q(R.SCENARIO_COUNTRY)} THEN {uk[R.SCENARIO_COUNTRY]}
              ELSE {uk[R.SCENARIO_LANGUAGE_COUNTRY]} END AS unit_key,
         CAST(l_partkey % {n} AS INTEGER) AS criterion_id,
         l_orderkey, l_linenumber, l_partkey, l_suppkey, l_discount, l_tax, l_quantity
  FROM (SELECT *, {sc} AS scenario FROM lineitem)),
li_cell AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY scenario, model, unit_key, criterion_id
        ORDER BY l_orderkey DESC, l_linenumber DESC, l_partkey DESC, l_suppkey DESC, l_discount DESC,
                 l_tax DESC, l_quantity DESC) AS _rn FROM li_keyed) WHERE _rn = 1),
item_base AS (
  SELECT scenario, model, unit_key, criterion_id,
         CASE WHEN {npr(p, 1)} < 0.3 THEN 0.0 ELSE {npr(p, 1)} END AS fact,
         l_tax / 0.08 AS support, {qq} AS opposition,
         CASE WHEN {fval} > 0 THEN {npr(f'1 - 4 * {p} * (1 - {p})', 2)} END AS fact_coherence,
         {fval} AS fact_validity,
         CASE WHEN {sval} > 0 THEN {npr(f'1 - 4 * {qq} * (1 - {qq})', 2)} END AS stance_coherence,
         {sval} AS stance_validity
  FROM li_cell),
item_scores AS (
  SELECT *, {npr('(support + abs(opposition - 1.0)) / 2.0', 2)} AS stance,
         coalesce({npr('fact_coherence * fact_validity', 2)}, 0.0) AS fact_weighted,
         coalesce({npr('stance_coherence * stance_validity', 2)}, 0.0) AS stance_weighted
  FROM item_base)"""


def cte_truth_long(n: int = R.TEST_RULES.n_criteria) -> str:
    at = f"(o_orderkey % ({D.N_COUNTRIES} * {N_GROUPS}))"
    return f"""truth_long AS (
  SELECT country_id, criterion_id,
         CAST(CASE WHEN status = 'F' THEN 1.0 WHEN status = 'P' THEN 0.5 ELSE 0.0 END AS DOUBLE) AS score
  FROM (SELECT country_id, criterion_id, arg_max(o_orderstatus, o_orderkey) AS status
        FROM (SELECT {of_group(D.COUNTRY_IDS, at)} AS country_id, CAST(o_custkey % {n} AS INTEGER) AS criterion_id,
                     o_orderkey, o_orderstatus FROM orders)
        GROUP BY country_id, criterion_id))"""


def cte_weights(n: int = R.TEST_RULES.n_criteria) -> str:
    return f"""weights AS (
  SELECT criterion_id, {npr('w * 100.0 / sum(w) OVER ()', 10)} AS weight
  FROM (SELECT CAST(p_partkey % {n} AS INTEGER) AS criterion_id, avg(p_size) AS w FROM part GROUP BY 1))"""


def prereq_case(col: str, unit: str, rules: R.AuditRules) -> str:
    if not rules.prerequisites:
        return col
    parts = []
    for cid, req in sorted(rules.prerequisites.items()):
        reqv = f"max(CASE WHEN criterion_id = {req} THEN {col} END) OVER (PARTITION BY {unit})"
        parts.append(f"WHEN criterion_id = {cid} AND NOT (coalesce({reqv}, 0.0) > 0) THEN 0.0")
    return f"CASE {' '.join(parts)} ELSE {col} END"


def item_id_sql(rules: R.AuditRules) -> str:
    parts = [f"WHEN criterion_id IN ({', '.join(str(m) for m in members)}) THEN {g}"
             for g, members in sorted(rules.exclusive_groups.items())]
    return f"CASE {' '.join(parts)} ELSE criterion_id END" if parts else "criterion_id"


def cte_adjusted(name: str, src: str, unit: list[str], scores: list[str], rules: R.AuditRules) -> str:
    """Prerequisite gate + weights + exclusive-group collapse: unit, item_id, <score>_w."""
    u = ", ".join(unit)
    gated = ", ".join(f"{prereq_case(s, u, rules)} AS {s}" for s in scores)
    aggs = ", ".join(f"max({s}) * first(weight ORDER BY {s} DESC, criterion_id ASC) AS {s}_w" for s in scores)
    return f"""{name}_g AS (SELECT {u}, criterion_id, {gated} FROM {src}),
{name} AS (
  SELECT {u}, item_id, {aggs}
  FROM (SELECT g.*, w.weight, {item_id_sql(rules)} AS item_id FROM {name}_g g JOIN weights w USING (criterion_id))
  GROUP BY {u}, item_id)"""


def cte_gate(name: str, src: str, unit: list[str], n: int) -> str:
    u = ", ".join(unit)
    return f"""{name} AS (
  SELECT s.* FROM {src} s SEMI JOIN (
    SELECT {u} FROM {src} GROUP BY {u} HAVING count(*) = {n} AND count(DISTINCT criterion_id) = {n}) c USING ({u}))"""


def rank_sql(keys: str, d: str) -> tuple[str, str]:
    part = f"PARTITION BY {keys}, ({d} <> 0)"
    rank = f"rank() OVER ({part} ORDER BY abs({d}))"
    tie = f"count(*) OVER ({part}, abs({d}))"
    return rank, tie


def signed_rank_select(prefix: str) -> str:
    """From columns <p>_n, <p>_rp, <p>_rm, <p>_tt -> <p>_stat, <p>_pvalue."""
    n = f"CAST({prefix}_n AS DOUBLE)"
    var = f"({n} * ({n} + 1) * (2 * {n} + 1) / 24.0 - {prefix}_tt / 48.0)"
    z = f"(({prefix}_rp - {n} * ({n} + 1) / 4.0) / sqrt({var}))"
    p = f"CASE WHEN {prefix}_n > 0 AND {var} > 0 THEN {erfc_sql(f'abs({z}) / sqrt(2.0)')} END"
    return f"{npr(f'least({prefix}_rp, {prefix}_rm)', 2)} AS {prefix}_stat, {npr(p, 2)} AS {prefix}_pvalue"


def signed_rank_aggs(prefix: str, d: str) -> str:
    return (f"sum(CASE WHEN {d} <> 0 THEN 1 ELSE 0 END) AS {prefix}_n, "
            f"coalesce(sum(CASE WHEN {d} > 0 THEN {prefix}_rank END), 0.0) AS {prefix}_rp, "
            f"coalesce(sum(CASE WHEN {d} < 0 THEN {prefix}_rank END), 0.0) AS {prefix}_rm, "
            f"CAST(coalesce(sum(CASE WHEN {d} <> 0 THEN {prefix}_tie * {prefix}_tie - 1 END), 0) AS DOUBLE) AS {prefix}_tt")


def cte_comparison(rules: R.AuditRules = R.TEST_RULES) -> str:
    """item_scores, truth_long, weights, units -> comparison."""
    n = rules.n_criteria
    unit = ["scenario", "model", "unit_key"]
    keys = "scenario, model, unit_key, country_id"
    fr, ft = rank_sql(keys, "fact_d")
    sr, st = rank_sql(keys, "stance_d")
    return ",\n".join([
        cte_gate("m_gated", "item_scores", unit, n),
        "m_scores AS (SELECT scenario, model, unit_key, criterion_id, CAST(fact AS DOUBLE) AS fact, "
        "(support + (1.0 - opposition)) / 2.0 AS stance FROM m_gated)",
        cte_adjusted("meter", "m_scores", unit, ["fact", "stance"], rules),
        cte_gate("t_gated", "(SELECT * FROM truth_long WHERE score IS NOT NULL)", ["country_id"], n),
        cte_adjusted("truthv", "t_gated", ["country_id"], ["score"], rules),
        f"""paired AS (
  SELECT m.*, l.country_id, t.score_w,
         {npr('m.fact_w - t.score_w', 10)} AS fact_d, {npr('m.stance_w - t.score_w', 10)} AS stance_d
  FROM meter m
  JOIN (SELECT DISTINCT scenario, model, unit_key, country_id FROM units) l USING (scenario, model, unit_key)
  JOIN truthv t ON t.country_id = l.country_id AND t.item_id = m.item_id)""",
        f"""ranked AS (
  SELECT *, {fr} + ({ft} - 1) / 2.0 AS fact_rank, {ft} AS fact_tie,
            {sr} + ({st} - 1) / 2.0 AS stance_rank, {st} AS stance_tie
  FROM paired)""",
        f"""ustats AS (
  SELECT {keys},
         {stable_py('sum(fact_w)', 2)} AS fact, {stable_py('sum(stance_w)', 2)} AS stance,
         {stable_py('sum(score_w)', 2)} AS truth,
         {stable('avg(abs(score_w - fact_w))', 2)} AS fact_mae,
         {stable('avg(abs(score_w - stance_w))', 2)} AS stance_mae,
         {signed_rank_aggs('fact', 'fact_d')}, {signed_rank_aggs('stance', 'stance_d')}
  FROM ranked GROUP BY {keys})""",
        f"""comparison AS (
  SELECT u.scenario, u.model, u.unit_key, u.country_id, u.country, u.language, u.language_code,
         s.fact, s.stance, s.truth, {signed_rank_select('fact')}, s.fact_mae,
         {signed_rank_select('stance')}, s.stance_mae
  FROM ustats s JOIN units u USING (scenario, model, unit_key, country_id))""",
    ])


def with_inputs(body: str, *ctes: str) -> str:
    if not ctes:
        return body
    return "WITH " + ",\n".join(ctes) + "\n" + body


def comparison_inputs(rules: R.AuditRules = R.TEST_RULES) -> list[str]:
    n = rules.n_criteria
    return [cte_countries(), cte_pairs(), cte_units(), cte_item_scores(n), cte_truth_long(n), cte_weights(n),
            cte_comparison(rules)]
