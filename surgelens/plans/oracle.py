"""DuckDB statements for the registered queries, built from shared common table expressions."""

from __future__ import annotations

from surgelens.registry import FAMILY_FEATURES, TWIN_IDS, col_of

BASE = 1704067200000000


def r6(expr: str) -> str:
    return f"CAST(round(CAST(CAST({expr} AS DOUBLE) AS DECIMAL(38,12)), 6) AS DOUBLE) + 0.0"


def secs(minute: str) -> str:
    """Epoch minute as comparable epoch seconds."""
    return f"CAST(({minute}) * 60 AS DOUBLE)"


def events_cte(axis: str) -> str:
    us = f"({BASE} + (epoch_us(ts) - {BASE}) // 60)" if axis == "dense" else "epoch_us(ts)"
    return f"""SELECT e.event_id AS n, e.user_id, e.event_type AS et, e.value, CAST(json_extract(e.props, '$.k') AS BIGINT) AS k,
  e.user_id % 8 AS mi, {us} AS us, ({BASE} + (epoch_us(ts) - {BASE}) // 60) // 60000000 AS dm FROM events e"""


def attempts_cte(src: str) -> str:
    return f"""SELECT n, k, mi, et, us, us // 60000000 AS m, 'txn_' || n AS transaction_id, 'm_' || mi AS merchant_id,
  CASE WHEN n % 17 <> 0 THEN 'cus_' || user_id END AS customer_id, 'ord_' || n AS order_id,
  'if_' || (user_id * 7 + k % 3) AS ins,
  CASE WHEN k % 4 = 0 THEN NULL WHEN k % 4 = 1 THEN 'US' ELSE 'IN' END AS issuer_country,
  CASE WHEN k % 11 <> 0 THEN 'bin_' || (k % 6) END AS bin_hash,
  CASE WHEN n % 13 <> 0 THEN 'dv_' || k END AS device_fp,
  CASE WHEN n % 19 <> 0 THEN 'ip_' || (k % 25) END AS ip_fp,
  coalesce(CASE WHEN n_nationkey < 20 THEN 'IN' ELSE 'X' || n_nationkey END, 'IN') AS country, n_name AS state, r_name AS city,
  CAST(value AS DECIMAL(14,2)) AS amount,
  (['CARD','UPI','NETBANKING','WALLET','EMI','COD','PAY_LATER'])[k % 7 + 1] AS method,
  (et = 'view' AND k % 10 = 0) AS is_cod, CASE WHEN et = 'signup' THEN 'C1' END AS coupon_id,
  CASE WHEN n % 10 = 0 THEN 2 ELSE 1 END AS attempt_number,
  CASE WHEN et = 'error' THEN 'FAILED' WHEN k % 5 = 0 THEN 'AUTHORIZED' ELSE 'CAPTURED' END AS status,
  CASE WHEN et = 'error' AND k % 4 = 3 THEN 'GATEWAY' WHEN et = 'error' THEN 'ISSUER' ELSE 'UNKNOWN' END AS decline_source,
  CASE WHEN et = 'error' THEN (['DO_NOT_HONOR','INSUFFICIENT_FUNDS','INCORRECT_OTP','GATEWAY_TIMEOUT'])[k % 4 + 1] END AS failure_code,
  (et = 'purchase' AND k % 9 = 0) AS refunded, us + k * 3600000000 AS refund_us,
  CASE WHEN et = 'view' AND k % 10 = 0 THEN 'RTO' ELSE 'DELIVERED' END AS order_status,
  (et = 'error' AND k % 20 = 0) AS disputed, 14 + k % 30 AS dispute_days,
  coalesce(CASE WHEN n % 17 <> 0 THEN 'cus_' || user_id END, 'anon_cus_txn_' || n) AS cus,
  coalesce(CASE WHEN n % 13 <> 0 THEN 'dv_' || k END, 'anon_dev_txn_' || n) AS dev,
  coalesce(CASE WHEN n % 19 <> 0 THEN 'ip_' || (k % 25) END, 'anon_ip_txn_' || n) AS ip,
  (dm % 90 < 10 AND mi % 2 = 0 AND k < 70) AS is_abusive,
  ((dm % 90 < 10 AND mi % 2 = 0 AND k < 70) OR (dm % 90 BETWEEN 40 AND 49 AND mi % 2 = 1 AND k < 80)) AS is_spike,
  CASE WHEN dm % 90 < 10 AND mi % 2 = 0 AND k < 70 THEN 'card_testing_burst'
       WHEN dm % 90 BETWEEN 40 AND 49 AND mi % 2 = 1 AND k < 80 THEN 'flash_sale_spike' ELSE 'normal_day' END AS scenario_id
  FROM {src} LEFT JOIN customer ON c_custkey = user_id LEFT JOIN nation ON n_nationkey = c_nationkey
  LEFT JOIN region ON r_regionkey = n_regionkey"""


WK = "merchant_id, window_size, e"

CTES: dict[str, tuple[list[str], str]] = {
    "ev": ([], events_cte("dense")),
    "evc": ([], events_cte("calendar")),
    "att": (["ev"], attempts_cte("ev")),
    "attc": (["evc"], attempts_cte("evc")),
    "h": ([], "SELECT * FROM (VALUES ('1m', 1), ('5m', 5), ('15m', 15), ('1h', 60)) t(window_size, steps)"),
    "offs": ([], "SELECT unnest(range(60)) AS o"),
    "win": (["att", "h", "offs"], "SELECT a.*, h.window_size, h.steps, a.m + 1 + o AS e FROM att a JOIN h ON true JOIN offs ON o < h.steps"),
    "cats": ([], "SELECT 'm_' || c_custkey AS merchant_id, c_mktsegment AS category FROM customer WHERE c_custkey BETWEEN 0 AND 6"),
    "sc": ([], "SELECT event_id, CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS y, "
               "least(1.0::DOUBLE, ((event_id * 37) % 1000) / 1000.0::DOUBLE + CASE WHEN event_type = 'error' THEN 0.2::DOUBLE ELSE 0.0::DOUBLE END) AS p, value AS loss FROM events"),
    "spine": (["att", "h"], "SELECT merchant_id, window_size, steps, unnest(range(lo + steps, hi + 2)) AS e FROM "
              "(SELECT merchant_id, min(m) AS lo, max(m) AS hi FROM att GROUP BY 1) JOIN h ON lo + steps <= hi + 1"),
    # plain sums per window
    "f_base": (["win"], f"""SELECT {WK}, any_value(steps) AS steps, count(*) AS n,
      count(*) FILTER (status IN ('CAPTURED','AUTHORIZED')) AS success, count(*) FILTER (status = 'FAILED') AS failure,
      count(*) FILTER (decline_source = 'ISSUER') AS iss_dec, count(*) FILTER (refunded) AS refunds,
      count(coupon_id) AS coupons, count(*) FILTER (is_cod OR method = 'COD') AS cod,
      count(*) FILTER (country <> 'IN') AS intl, count(*) FILTER (attempt_number > 1) AS retries,
      count(*) FILTER (method = 'CARD') AS card, count(*) FILTER (amount < 100) AS low, count(*) FILTER (amount > 10000) AS high,
      CAST(sum(amount) AS DOUBLE) AS gmv, CAST(median(CAST(amount AS DOUBLE)) AS DOUBLE) AS amt_median,
      stddev_samp(CAST(amount AS DOUBLE)) AS amt_std, count(DISTINCT cus) AS cuss, count(DISTINCT dev) AS devs,
      count(DISTINCT ins) AS inss, count(DISTINCT ip) AS ips,
      count(DISTINCT country) FILTER (country <> 'IN') AS foreign_n FROM win GROUP BY {WK}"""),
    "f_gap": (["win"], f"""SELECT {WK}, count(*) AS gaps, avg(gap) / 1e6 AS gap_mean, stddev_samp(gap) / 1e6 AS gap_std,
      max(CASE WHEN rn = CAST(floor(0.05::DOUBLE * cnt) AS BIGINT) + 1 THEN gap END) / 1e6 AS p05 FROM
      (SELECT {WK}, CAST(gap AS DOUBLE) AS gap, row_number() OVER (PARTITION BY {WK} ORDER BY gap) AS rn, count(*) OVER (PARTITION BY {WK}) AS cnt
       FROM (SELECT {WK}, us - lag(us) OVER (PARTITION BY {WK} ORDER BY us) AS gap FROM win) WHERE gap IS NOT NULL) GROUP BY {WK}"""),
    "f_items": (["win"], " UNION ALL ".join(
        f"SELECT {WK}, '{dim}' AS dim, CAST({col} AS VARCHAR) AS item, {cnt} AS c FROM win {where} GROUP BY {WK}, {col}"
        for dim, col, cnt, where in [
            ("country", "country", "count(*)", ""), ("state", "coalesce(state, 'UNKNOWN')", "count(*)", ""),
            ("method", "method", "count(*)", ""), ("issuer", "coalesce(issuer_country, 'IN')", "count(*)", ""),
            ("bin", "coalesce(bin_hash, 'UNKNOWN')", "count(*)", ""), ("decline", "failure_code", "count(*)", "WHERE failure_code IS NOT NULL"),
            ("dev", "dev", "count(*)", ""), ("cus", "cus", "count(*)", ""),
            ("dev_cus", "dev", "count(DISTINCT cus)", ""), ("dev_ins", "dev", "count(DISTINCT ins)", ""),
            ("dev_deg", "dev", "count(DISTINCT cus) + count(DISTINCT ins)", ""),
            ("cus_dev", "cus", "count(DISTINCT dev)", ""), ("ip_cus", "ip", "count(DISTINCT cus)", "")])),
    "f_prof": (["f_items"], f"""SELECT {WK}, dim, max(c) AS top, avg(c) AS mean,
      greatest(0.0, log2(sum(c)) - sum(c * log2(c)) / sum(c)) AS ent,
      2.0 * sum(rn * c) / (count(*) * sum(c)) - (count(*) + 1.0) / count(*) AS gini FROM
      (SELECT *, row_number() OVER (PARTITION BY {WK}, dim ORDER BY c) AS rn FROM f_items) GROUP BY {WK}, dim"""),
    "f_wide": (["f_prof"], f"""SELECT {WK}, """ + ", ".join(
        f"max({metric}) FILTER (dim = '{dim}') AS {metric}_{dim}" for metric, dim in
        [("top", "dev"), ("top", "cus"), ("top", "decline"), ("top", "dev_cus"), ("top", "dev_ins"), ("top", "cus_dev"), ("top", "ip_cus"),
         ("mean", "dev_cus"), ("ent", "country"), ("ent", "state"), ("ent", "method"), ("ent", "issuer"), ("ent", "decline"),
         ("gini", "state"), ("gini", "bin"), ("gini", "dev_cus"), ("gini", "dev_deg")]) + f" FROM f_prof GROUP BY {WK}"),
    "f_bins": (["win", "f_base"], f"""SELECT {WK}, greatest(0.0, log2(sum(c)) - sum(c * log2(c)) / sum(c)) AS ent_amount FROM
      (SELECT w.merchant_id, w.window_size, w.e, least(9, CAST(floor(CAST(w.amount AS DOUBLE) / greatest(100.0, b.gmv / b.n * 2.0) * 10) AS INT)) AS bin, count(*) AS c
       FROM win w JOIN f_base b USING ({WK}) GROUP BY 1, 2, 3, 4) GROUP BY {WK}"""),
    "feat": (["f_base", "f_gap", "f_wide", "f_bins"], f"""SELECT b.merchant_id, b.window_size, b.steps, b.e,
      b.n / b.steps AS A_txn_rate, b.n / b.steps AS A_rate_accel, 0.0 AS A_burst_duration,
      coalesce(gap_mean, b.steps * 60.0 / n) AS A_interarrival_mean,
      CASE WHEN gaps IS NULL THEN 1.0 WHEN gaps = 1 THEN 0.0 ELSE gap_std / greatest(0.0001, gap_mean) END AS A_interarrival_cv,
      coalesce(p05, b.steps * 60.0 / n) AS A_interarrival_p05,
      greatest(0.0, 1.0 - least(1.0, CASE WHEN gaps IS NULL THEN 1.0 WHEN gaps = 1 THEN 0.0 ELSE gap_std / greatest(0.0001, gap_mean) END)) AS A_periodicity_score,
      0.0 AS A_hour_of_week_dev, n AS B_txn_count, success AS B_success_count, failure AS B_failure_count, cuss AS B_unique_customers,
      inss AS B_unique_instruments, devs AS B_unique_devices, ips AS B_unique_ips, failure / n AS C_failure_rate, devs / n AS C_devices_per_txn,
      cuss / n AS C_accounts_per_txn, inss / n AS C_instruments_per_txn, ips / n AS C_ips_per_txn, 1.0 AS C_instrument_novelty,
      1.0 AS C_account_novelty, 1.0 AS C_device_novelty, coupons / n AS C_coupon_rate, cod / n AS C_cod_rate, intl / n AS C_international_rate,
      retries / n AS C_retry_rate, gmv AS D_gmv, amt_median AS D_amount_median, coalesce(amt_std, 0.0) / greatest(1.0, gmv / n) AS D_amount_cv,
      ent_amount AS D_amount_entropy, low / n AS D_low_value_ratio, high / n AS D_high_value_ratio, coupons * 100.0 / greatest(1.0, gmv) AS D_discount_to_gmv,
      ent_country AS E_country_entropy, ent_state AS E_state_entropy, 0.0 AS E_geo_mix_jsd, foreign_n AS E_new_country_count, gini_state AS E_geo_gini,
      0.0 AS E_geo_transition_rate, top_dev_cus AS F_accounts_per_device_max, mean_dev_cus AS F_accounts_per_device_mean,
      gini_dev_cus AS F_accounts_per_device_gini, top_dev AS F_txn_per_device_max, top_dev_ins AS F_instruments_per_device_max,
      1.0 - devs / n AS F_device_reuse_rate, 168.0 AS G_account_age_median, 24.0 AS G_account_age_p10, 1.0 AS G_new_account_rate,
      top_cus AS G_txn_per_account_max, 1.0 AS G_accounts_per_address_max, cuss / n AS G_account_cohort_concentration,
      ent_method AS H_method_entropy, 0.0 AS H_method_mix_jsd, card / n AS H_card_share, ent_issuer AS H_issuer_country_entropy,
      gini_bin AS H_bin_prefix_gini, n / inss AS H_instrument_repeat_rate, coalesce(ent_decline, 0.0) AS I_decline_code_entropy,
      coalesce(top_decline, 0) / greatest(1, failure) AS I_decline_code_top_share, iss_dec / greatest(1, failure) AS I_decline_issuer_share,
      refunds / n AS I_refund_rate, CASE WHEN refunds > 0 THEN 4.0 ELSE 0.0 END AS I_refund_latency_median, 0.0 AS I_refund_cohort_concentration,
      0.0 AS I_dispute_rate, 0.0 AS I_rto_rate, 0.0 AS I_chargeback_rate, top_cus_dev AS J_devices_per_account_max,
      top_ip_cus AS J_accounts_per_ip_max, gini_dev_deg AS J_bipartite_gini, 1.0 AS J_entity_novelty_share
      FROM f_base b LEFT JOIN f_gap USING ({WK}) LEFT JOIN f_wide USING ({WK}) LEFT JOIN f_bins USING ({WK})"""),
}

ROUNDS = 32  # of neighbour minima and label jumps; no chain of the fixtures' windows is longer


def _label_rounds() -> dict[str, tuple[list[str], str]]:
    out = {"g_l0": (["g_v"], "SELECT w, v, v AS l FROM g_v")}
    for k in range(ROUNDS):
        out[f"g_m{k}"] = ([f"g_l{k}", "g_e"], f"""SELECT w, v, min(l) AS l FROM (SELECT w, v, l FROM g_l{k}
          UNION ALL SELECT e.w, e.b, x.l FROM g_e e JOIN g_l{k} x ON x.w = e.w AND x.v = e.a UNION ALL SELECT e.w, e.a, x.l FROM g_e e JOIN g_l{k} x ON x.w = e.w AND x.v = e.b) GROUP BY 1, 2""")
        out[f"g_l{k + 1}"] = ([f"g_m{k}"], f"SELECT x.w, x.v, y.l FROM g_m{k} x JOIN g_m{k} y ON y.w = x.w AND y.v = x.l")
    return out


CTES |= {
    "g_w": (["win"], f"SELECT {WK}, row_number() OVER () AS w, count(*) AS n FROM win GROUP BY {WK}"),
    "g_id": (["att"], "SELECT x, row_number() OVER (ORDER BY x) AS v FROM (SELECT 'CUS:' || cus AS x FROM att UNION SELECT 'DEV:' || dev FROM att UNION SELECT 'INS:' || ins FROM att UNION SELECT 'IP:' || ip FROM att)"),
    "g_t": (["att", "g_id"], """SELECT a.transaction_id, c.v AS c, d.v AS d, i.v AS i, p.v AS p FROM att a JOIN g_id c ON c.x = 'CUS:' || cus JOIN g_id d ON d.x = 'DEV:' || dev
      JOIN g_id i ON i.x = 'INS:' || ins JOIN g_id p ON p.x = 'IP:' || ip"""),
    "g_x": (["win", "g_w", "g_t"], f"SELECT w, c, d, i, p, us FROM win JOIN g_w USING ({WK}) JOIN g_t USING (transaction_id)"),
    "g_e": (["g_x"], "SELECT w, c AS a, d AS b FROM g_x UNION SELECT w, d, i FROM g_x UNION SELECT w, c, p FROM g_x"),
    "g_v": (["g_x"], "SELECT w, v, min(us) AS us FROM (SELECT w, us, unnest([c, d, i, p]) AS v FROM g_x) GROUP BY 1, 2"),
    **_label_rounds(),
    "g_c": ([f"g_l{ROUNDS}", "g_v", "g_e"], f"""SELECT a.w, a.l, nodes, us, edges FROM (SELECT w, l, count(*) AS nodes, min(us) AS us FROM g_l{ROUNDS} JOIN g_v USING (w, v) GROUP BY 1, 2) a
      JOIN (SELECT e.w, l, count(*) AS edges FROM g_e e JOIN g_l{ROUNDS} x ON x.w = e.w AND x.v = e.a GROUP BY 1, 2) b ON a.w = b.w AND a.l = b.l"""),
    "g_f": (["g_c", "g_w"], f"""SELECT {WK}, count(*) AS J_cluster_count, arg_max(edges, (nodes, -us, edges)) AS J_largest_cluster_size, least(1.0, arg_max(edges, (nodes, -us, edges)) / any_value(n)) AS J_largest_cluster_vol_share,
      arg_max(edges / nodes, (nodes, -us, edges)) AS J_cluster_density, arg_max(CASE WHEN nodes > 2 THEN edges / nodes / greatest(1.0, (nodes - 1) / 2.0) ELSE 0.0 END, (nodes, -us, edges)) AS J_cluster_density_z,
      0.0 AS J_cross_merchant_entities, 1.0 AS J_cross_merchant_fanout_max, 0.0 AS J_shared_address_clusters FROM g_c JOIN g_w USING (w) GROUP BY {WK}"""),
    "featj": (["feat", "g_f"], f"SELECT * FROM feat JOIN g_f USING ({WK})"),
}

GRAPH_CLUSTER = {"J.cluster_count", "J.largest_cluster_size", "J.largest_cluster_vol_share", "J.cluster_density",
                 "J.cluster_density_z", "J.cross_merchant_entities", "J.cross_merchant_fanout_max", "J.shared_address_clusters"}
PLAIN_FEATURES = [f"{fam}.{x}" for fam, names in FAMILY_FEATURES.items() for x in names if f"{fam}.{x}" not in GRAPH_CLUSTER]


def with_ctes(names: list[str], body: str, extra: dict[str, str] | None = None) -> str:
    """WITH clause holding ``names`` and what they need, in order, then ``extra``, then the body."""
    order: list[str] = []

    def need(name: str) -> None:
        if name in order:
            return
        for dep in CTES[name][0]:
            need(dep)
        order.append(name)

    for name in names:
        need(name)
    parts = [f"{n} AS MATERIALIZED ({CTES[n][1]})" if n in ("att", "attc", "win", "feat", "featj") or n.startswith("g_") else f"{n} AS ({CTES[n][1]})" for n in order]
    parts += [f"{n} AS ({q})" for n, q in (extra or {}).items()]
    return f"WITH {', '.join(parts)} {body}" if parts else body


def feature_select(source: str = "feat") -> str:
    cols = ", ".join(f"{r6(col_of(f))} AS {col_of(f)}" for f in PLAIN_FEATURES)
    return f"SELECT merchant_id, window_size, {secs('e')} AS window_end, {cols} FROM {source}"
