"""DuckDB SQL for the registered screening queries, written from the definitions and not from the Spark plans."""

from __future__ import annotations

from . import fixtures as fx

START, END = fx.REGION
N = END - START + 1
K, K2 = 9, 15

WT_FIXED = f"wt_lib AS (SELECT 'WT' AS variant_id, '{fx.WT}' AS aa_sequence, 'wt' AS criteria)"
WT_SEEN = f"""wt_lib AS (SELECT 'WT' AS variant_id, '{fx.LEFT}' || vr || '{fx.RIGHT}' AS aa_sequence, 'wt' AS criteria
FROM (SELECT substr(aa_sequence, {START}, {N}) AS vr FROM library GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1))"""
LIBRARY = f"""library AS ({fx.duck_library()}),
kept AS (SELECT * FROM library WHERE position('*' IN substr(aa_sequence, {START}, {N})) = 0),
{WT_FIXED}"""

OVERLAP = f"s + {{k}} - 1 >= {START} AND s <= {END}"
CONTAINED = f"s >= {START} AND s + {{k}} - 1 <= {END}"


def rounded(x: str) -> str:
    return f"CASE WHEN round({x}, 6) = 0 THEN 0.0 ELSE round({x}, 6) END"


def windows(source: str, k: int, where: str) -> str:
    return f"""SELECT variant_id, criteria, {k}::int AS k, substr(aa_sequence, s::int, {k}) AS peptide, s::int AS start, (s + {k} - 1)::int AS "end"
FROM (SELECT *, unnest(range(1, length(aa_sequence) - {k} + 2)) AS s FROM {source}) WHERE {where.format(k=k)}"""


FRAG = f"{LIBRARY},\nfrag AS ({windows('kept', K, OVERLAP)}),\nfrag_wt AS ({windows('wt_lib', K, OVERLAP)})"
FRAG2 = f"{LIBRARY},\nfrag AS ({windows('kept', K2, OVERLAP)}),\nfrag_wt AS ({windows('wt_lib', K2, OVERLAP)})"


def mapped(name: str, frag: str, alleles: list[str], columns: dict[str, str], flag: str, score: str, threshold: float) -> str:
    cols = ", ".join(f"{sql} AS {c}" for c, sql in columns.items())
    return f"""{name} AS (SELECT allele, NULL::varchar AS peptide_id, f.peptide, k, variant_id, start, "end", length(f.peptide)::int AS length, occurrence_count, criteria,
{", ".join(columns)}, coalesce({score} < {threshold}, false) AS {flag}
FROM {frag} f JOIN (SELECT peptide, count(*) AS occurrence_count FROM {frag} GROUP BY 1) u USING (peptide)
JOIN (SELECT allele, peptide, {cols} FROM (SELECT DISTINCT peptide FROM {frag}), {fx.duck_alleles(alleles)}) p USING (peptide))"""


NET_COLUMNS = {"netMHCpan_EL_score": fx.duck_score("ns"), "netMHCpan_EL_rank": fx.duck_score("nr")}
FLURRY_COLUMNS = {"MHCflurry_affinity_percentile": fx.duck_score("fa"), "MHCflurry_presentation_percentile": fx.duck_score("fp")}
MHCII_COLUMNS = {"netMHCIIpan_core": "substr(peptide, 4, 9)", "netMHCIIpan_inverted": "0.0::double", "netMHCIIpan_EL_score": fx.duck_score("2s"), "netMHCIIpan_EL_rank": fx.duck_score("2r")}


def net(name: str = "net", frag: str = "frag") -> str:
    return mapped(name, frag, fx.ALLELES, NET_COLUMNS, "netMHCpan_EL_rank_pass", "netMHCpan_EL_rank", 2.0)


def flurry(name: str = "flurry", frag: str = "frag") -> str:
    return mapped(name, frag, fx.ALLELES, FLURRY_COLUMNS, "MHCflurry_affinity_percentile_pass", "MHCflurry_affinity_percentile", 2.0)


def mhcii(name: str = "two", frag: str = "frag") -> str:
    return mapped(name, frag, fx.ALLELES_2, MHCII_COLUMNS, "netMHCIIpan_EL_rank_binder", "netMHCIIpan_EL_rank", 5.0)


def diff(vr: str, wt: str) -> str:
    parts = f"list_transform(list_filter(range(1, least(length({vr}), length({wt})) + 1), lambda i: substr({vr}, i::int, 1) <> substr({wt}, i::int, 1)), lambda i: substr({wt}, i::int, 1) || i || substr({vr}, i::int, 1))"
    return f"CASE WHEN len({parts}) = 0 THEN 'WT' ELSE array_to_string({parts}, ';') END"


LABELS = f"""labels AS (SELECT variant_id, vr AS VR_sequence, {diff("vr", f"'{fx.VR}'")} AS VR_mutation
FROM (SELECT variant_id, substr(aa_sequence, {START}, {N}) AS vr FROM library))"""
PEPTIDE_LABEL = f"""CASE WHEN VR_mutation IS NULL OR VR_mutation = 'WT' THEN 'WT' ELSE coalesce(nullif(array_to_string(list_filter(string_split(VR_mutation, ';'),
lambda m: regexp_extract(m, '[0-9]+')::int + {START - 1} BETWEEN start AND "end"), ';'), ''), 'WT') END"""
COUNT = "CASE WHEN VR_mutation IS NULL OR upper(trim(VR_mutation)) IN ('', 'WT') THEN 0 ELSE len(string_split(VR_mutation, ';')) END"

PAIRED = """SELECT allele, variant_id, peptide, start, "end", k, VR_mutation, netMHCpan_EL_rank AS n, netMHCpan_EL_rank_pass AS np, MHCflurry_affinity_percentile AS f, MHCflurry_affinity_percentile_pass AS fp,
netMHCpan_EL_rank_pass AND MHCflurry_affinity_percentile_pass AS bp, netMHCpan_EL_rank_pass OR MHCflurry_affinity_percentile_pass AS ep"""
JOIN = 'USING (allele, peptide, variant_id, start, "end", k)'
BOTH = f"""{FRAG}, {net()}, {flurry()}, {net("net_wt", "frag_wt")}, {flurry("flurry_wt", "frag_wt")}, {LABELS},
rows_v AS ({PAIRED} FROM net JOIN flurry {JOIN} LEFT JOIN labels USING (variant_id)),
rows_w AS ({PAIRED.replace("VR_mutation", "'WT' AS VR_mutation")} FROM net_wt JOIN flurry_wt {JOIN}),
rel AS (SELECT v.*, w.peptide AS wp, w.np AS wnp, w.fp AS wfp, w.bp AS wbp, w.ep AS wep, v.peptide <> w.peptide AS changed,
  CASE WHEN v.peptide = w.peptide THEN 0 ELSE w.n - v.n END AS ni, CASE WHEN v.peptide = w.peptide THEN 0 ELSE w.f - v.f END AS fi
  FROM rows_v v LEFT JOIN rows_w w USING (allele, start, "end", k))"""


def changes(name: str, own: str, wt: str) -> str:
    return f"""count(*) FILTER (WHERE {own} AND NOT {wt}) AS {name}_new_passed_count, count(*) FILTER (WHERE NOT {own} AND {wt}) AS {name}_lost_passed_count,
(count(*) FILTER (WHERE {own}) - count(*) FILTER (WHERE {wt})) AS {name}_net_pass_change"""


SCORES = f"""scores AS (SELECT allele, variant_id, min(VR_mutation) AS VR_mutation, count(wp) AS matched_window_count,
(SELECT count(*) FROM frag_wt) AS expected_window_count, count(*) FILTER (WHERE changed) AS changed_window_count,
{changes("netMHCpan", "np", "wnp")}, {changes("MHCflurry", "fp", "wfp")}, {changes("both", "bp", "wbp")},
avg(ni) AS netMHCpan_mean_window_improvement, avg(fi) AS MHCflurry_mean_window_improvement FROM rel GROUP BY 1, 2)"""
MUTATIONS = "mut AS (SELECT allele, variant_id, unnest(string_split(VR_mutation, ';')) AS mutation FROM scores WHERE VR_mutation <> 'WT')"

PARSED = f"""SELECT DISTINCT m AS mutation, regexp_extract(m, '^([A-Z])([0-9]+)([A-Z])$', 1) AS wt_aa, regexp_extract(m, '^([A-Z])([0-9]+)([A-Z])$', 3) AS mutant_aa,
regexp_extract(m, '[0-9]+')::int AS position_relative, regexp_extract(m, '[0-9]+')::int + {START - 1} AS position_absolute
FROM (SELECT unnest(string_split(VR_mutation, ';')) AS m FROM labels WHERE VR_mutation <> 'WT')"""
PARSED_OK = f"""parsed AS (SELECT mutation, CASE WHEN ok THEN wt_aa END AS wt_aa, CASE WHEN ok THEN mutant_aa END AS mutant_aa, CASE WHEN ok THEN position_relative END AS position_relative,
CASE WHEN ok THEN position_absolute END AS position_absolute FROM (SELECT *, mutant_aa <> '' AS ok FROM ({PARSED})))"""
COEFFICIENTS = f"""{LIBRARY}, {LABELS}, {PARSED_OK},
coef AS (SELECT * FROM (SELECT a.allele, o.outcome, parsed.*, {fx.duck_score("co", "a.allele||o.outcome", "parsed.mutation")} - 50.0 AS x,
  coalesce({fx.duck_score("st", "a.allele||o.outcome", "parsed.mutation")} / 100.0, 0.0) AS st
  FROM parsed, (SELECT DISTINCT 'a' || s_nationkey AS allele FROM supplier) a, (VALUES ('o1'), ('o2')) AS o(outcome)) WHERE x IS NOT NULL)"""
QUARTILES = "round(quantile_cont(x, 0.5), 6) AS {m}, round(quantile_cont(x, 0.25), 6) AS q1, round(quantile_cont(x, 0.75), 6) AS q3, round(quantile_cont(x, 0.75) - quantile_cont(x, 0.25), 6) AS allele_iqr"
SUMMARY = f"""SELECT outcome, mutation, {QUARTILES.format(m="median_coefficient")}, count(x) AS n_alleles, count(*) FILTER (WHERE x < 0) AS n_negative,
count(*) FILTER (WHERE x = 0) AS n_zero, count(*) FILTER (WHERE x > 0) AS n_positive,
round(greatest(count(*) FILTER (WHERE x < 0), count(*) FILTER (WHERE x = 0), count(*) FILTER (WHERE x > 0)) / count(x), 6) AS sign_agreement FROM coef GROUP BY 1, 2"""


DESIGN = f"""{BOTH}, {SCORES}, {MUTATIONS}, keep AS (SELECT allele, mutation FROM mut GROUP BY 1, 2 HAVING count(*) >= 5),
x AS (SELECT allele, variant_id, mutation AS m FROM mut SEMI JOIN keep USING (allele, mutation) UNION ALL SELECT allele, variant_id, '' FROM scores),
y AS (SELECT allele, variant_id, 'netMHCpan_net_pass_change' AS outcome, netMHCpan_net_pass_change::double AS value FROM scores UNION ALL
      SELECT allele, variant_id, 'MHCflurry_net_pass_change', MHCflurry_net_pass_change::double FROM scores UNION ALL
      SELECT allele, variant_id, 'netMHCpan_mean_window_improvement', netMHCpan_mean_window_improvement FROM scores WHERE netMHCpan_mean_window_improvement IS NOT NULL UNION ALL
      SELECT allele, variant_id, 'MHCflurry_mean_window_improvement', MHCflurry_mean_window_improvement FROM scores WHERE MHCflurry_mean_window_improvement IS NOT NULL)"""


ABS_SCORES = f"""WITH {BOTH}, one AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY allele, variant_id, peptide ORDER BY start) AS rn FROM rows_v) WHERE rn = 1),
nr AS (SELECT allele, variant_id, n, row_number() OVER (PARTITION BY allele, variant_id ORDER BY n) AS i FROM one WHERE n IS NOT NULL),
fr AS (SELECT allele, variant_id, f, row_number() OVER (PARTITION BY allele, variant_id ORDER BY f) AS i FROM one WHERE f IS NOT NULL)
SELECT o.*, round(a.m, 6) AS netMHCpan_mean_top3, round(b.m, 6) AS MHCflurry_mean_top3 FROM (
  SELECT allele, variant_id, min(VR_mutation) AS VR_mutation, max({COUNT})::bigint AS mutation_count, count(DISTINCT peptide) AS total_epitope_count, count(*) FILTER (WHERE np) AS netMHCpan_passed_count,
  count(*) FILTER (WHERE fp) AS MHCflurry_passed_count, count(*) FILTER (WHERE bp) AS both_passed_count, count(*) FILTER (WHERE ep) AS either_passed_count,
  min(n) AS netMHCpan_top_score, min(f) AS MHCflurry_top_score FROM one GROUP BY 1, 2) o
LEFT JOIN (SELECT allele, variant_id, avg(n) AS m FROM nr WHERE i <= 3 GROUP BY 1, 2) a USING (allele, variant_id)
LEFT JOIN (SELECT allele, variant_id, avg(f) AS m FROM fr WHERE i <= 3 GROUP BY 1, 2) b USING (allele, variant_id)"""
WT_SCORES = f"""WITH {BOTH}, {SCORES} SELECT * REPLACE ({rounded('netMHCpan_mean_window_improvement')} AS netMHCpan_mean_window_improvement, {rounded('MHCflurry_mean_window_improvement')} AS MHCflurry_mean_window_improvement),
({COUNT})::bigint AS mutation_count FROM scores"""


def _scale(values: dict[str, float], column: str) -> str:
    return "CASE " + column + " " + " ".join(f"WHEN '{k}' THEN {v}::double" for k, v in values.items()) + " END"


def build(hydrophobicity: dict[str, float], volume: dict[str, float], charge: dict[str, float]) -> dict[str, str]:
    out = {
        "library_clean": "SELECT trim(c_name) AS variant_id, replace(trim(c_mktsegment || ' ' || c_name), ' ', '') AS aa_sequence, trim(c_mktsegment) AS c_mktsegment FROM customer",
        "fragment_k9_overlap": f"WITH {FRAG} SELECT * FROM frag",
        "fragment_contained": f"WITH {LIBRARY} {windows('kept', K, CONTAINED)}",
        "fragment_all": f"WITH {LIBRARY} {windows('library', K, 'true')}",
        "fragment_multi_k": f"WITH {LIBRARY} " + " UNION ALL ".join(windows("kept", k, OVERLAP) for k in (8, 9, 10)),
        "stop_filter": f"WITH {LIBRARY} SELECT (SELECT count(*) FROM library) AS n_sequences, (SELECT count(*) FROM library) - (SELECT count(*) FROM kept) AS n_with_stop, (SELECT count(*) FROM kept) AS n_kept",
        "document_kmers": "SELECT peptide, 6::int AS k, count(*) AS occurrence_count FROM (SELECT substr(text, s::int, 6) AS peptide FROM (SELECT text, unnest(range(1, length(text) - 4)) AS s FROM documents)) GROUP BY 1",
        "unique_peptides": f"WITH {FRAG} SELECT peptide, k, count(*) AS occurrence_count FROM frag GROUP BY 1, 2",
        "numbered_peptides": f"""WITH {FRAG}, seen AS (SELECT peptide, k, count(*) AS occurrence_count, min(variant_id::bigint * 1000 + start) AS first_at FROM frag GROUP BY 1, 2)
SELECT 'pep_' || lpad((row_number() OVER (ORDER BY first_at))::varchar, 6, '0') AS peptide_id, peptide, k, occurrence_count FROM seen""",
        "peptide_map": f"WITH {FRAG} SELECT 'pep_' || peptide AS peptide_id, variant_id, start, \"end\", criteria FROM frag",
        "peptide_allele_pairs": f"WITH {FRAG} SELECT DISTINCT peptide, allele FROM frag, {fx.duck_alleles(fx.ALLELES)}",
        "allele_spelling": """SELECT raw, CASE WHEN trim(raw) LIKE 'H-2-__%' THEN 'H2-' || substr(trim(raw), 5, 1) || '*' || substr(trim(raw), 6) ELSE trim(raw) END AS allele, count(*) AS n
FROM (SELECT CASE c_custkey % 3 WHEN 0 THEN ' H-2-D' WHEN 1 THEN 'HLA-A*0' ELSE 'H-2-K' END || substr(c_mktsegment, 1, 2) AS raw FROM customer) GROUP BY 1, 2""",
        "incremental_scores": f"""WITH {FRAG.replace(WT_FIXED, WT_SEEN)}, pairs AS (
  SELECT peptide, allele, min(version)::int AS version FROM (SELECT peptide, 1 AS version FROM frag_wt UNION ALL SELECT peptide, 2 FROM frag), {fx.duck_alleles(fx.ALLELES)} GROUP BY 1, 2)
SELECT peptide, allele, {fx.duck_score('ns')} AS netMHCpan_EL_score, {fx.duck_score('nr')} AS netMHCpan_EL_rank, version FROM pairs""",
        "score_table": f"WITH {FRAG} SELECT peptide, allele, {fx.duck_score('ns')} AS netMHCpan_EL_score, {fx.duck_score('nr')} AS netMHCpan_EL_rank FROM (SELECT DISTINCT peptide, allele FROM frag, {fx.duck_alleles(fx.ALLELES)}) WHERE peptide NOT LIKE 'D%'",
        "score_map_mhci_wide": f"WITH {FRAG}, {net()} SELECT * FROM net",
        "stored_score_map": f"WITH {FRAG}, {net()} SELECT * FROM net",
        "score_map_mhci_long": f"WITH {FRAG}, {flurry()} SELECT * FROM flurry",
        "score_map_mhcii": f"WITH {FRAG2}, {mhcii()} SELECT * FROM two",
        "dedup_lowest_rank": f"WITH {FRAG}, {net()} SELECT allele, variant_id, start, peptide, netMHCpan_EL_rank FROM net",
        "pass_report": f"WITH {FRAG}, {net()} SELECT allele, count(*) AS n_rows, count(*) FILTER (WHERE netMHCpan_EL_rank_pass) AS n_netMHCpan_EL_rank_pass FROM net GROUP BY 1",
        "combine_outer": f"""WITH {FRAG}, {net()}, {flurry()}, l AS (SELECT * FROM net WHERE netMHCpan_EL_rank IS NOT NULL), r AS (SELECT * FROM flurry WHERE MHCflurry_affinity_percentile IS NOT NULL)
SELECT allele, peptide, variant_id, start, "end", k, coalesce(l.occurrence_count, r.occurrence_count) AS occurrence_count, coalesce(l.criteria, r.criteria) AS criteria,
netMHCpan_EL_score, netMHCpan_EL_rank, netMHCpan_EL_rank_pass, MHCflurry_affinity_percentile, MHCflurry_presentation_percentile, MHCflurry_affinity_percentile_pass,
CASE WHEN l.length IS NULL THEN 'right_only' WHEN r.length IS NULL THEN 'left_only' ELSE 'both' END AS merge_status FROM l FULL JOIN r {JOIN}""",
        "merge_status": f"""WITH {FRAG}, {net()}, {flurry()}, l AS (SELECT * FROM net WHERE netMHCpan_EL_rank IS NOT NULL), r AS (SELECT * FROM flurry WHERE MHCflurry_affinity_percentile IS NOT NULL)
SELECT CASE WHEN l.length IS NULL THEN 'right_only' WHEN r.length IS NULL THEN 'left_only' ELSE 'both' END AS merge_status, count(*) AS n_rows FROM l FULL JOIN r {JOIN} GROUP BY 1""",
        "vr_mutation": f"WITH {LIBRARY}, {LABELS} SELECT * FROM labels",
        "infer_wt_mode": f"WITH {LIBRARY} SELECT substr(aa_sequence, {START}, {N}) AS wt_vr FROM library GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1",
        "peptide_mutation": f"WITH {FRAG}, {LABELS} SELECT variant_id, start, VR_mutation, {PEPTIDE_LABEL} AS peptide_mutation FROM frag LEFT JOIN labels USING (variant_id)",
        "mutation_count": f"""WITH {LIBRARY}, {LABELS} SELECT variant_id, ({COUNT})::bigint AS n,
CASE WHEN VR_mutation = 'WT' THEN '' ELSE array_to_string(list_sort(string_split(VR_mutation, ';')), ',') END AS labels FROM labels""",
        "screen_mhci": f"""WITH {BOTH}, p AS (SELECT *, {PEPTIDE_LABEL} AS pm FROM rows_v)
SELECT allele, VR_mutation, count(*) AS n_rows, count(*) FILTER (WHERE np) AS n_net, count(*) FILTER (WHERE fp) AS n_flurry, count(*) FILTER (WHERE pm <> 'WT') AS n_changed FROM p GROUP BY 1, 2""",
        "screen_mhcii": f"""WITH {FRAG2}, {mhcii()}, {LABELS}, p AS (SELECT *, {PEPTIDE_LABEL} AS pm FROM two LEFT JOIN labels USING (variant_id))
SELECT allele, VR_mutation, count(*) AS n_rows, count(*) FILTER (WHERE netMHCIIpan_EL_rank_binder) AS n_binder, count(*) FILTER (WHERE pm <> 'WT') AS n_changed FROM p GROUP BY 1, 2""",
        "abs_scores": ABS_SCORES,
        "wt_reference": f"""WITH {BOTH.replace(WT_FIXED, WT_SEEN)} SELECT allele, start, "end", k, peptide AS wt_peptide_id, peptide AS wt_peptide, variant_id AS wt_variant_id, n AS "wt_netMHCpan_EL_rank", np AS "wt_netMHCpan_EL_rank_pass",
f AS "wt_MHCflurry_affinity_percentile", fp AS "wt_MHCflurry_affinity_percentile_pass", bp AS wt_both_pass, ep AS wt_either_pass, (SELECT count(*) FROM frag_wt) AS expected_window_count FROM rows_w""",
        "wt_windows": f"""WITH {BOTH} SELECT allele, variant_id, start, changed AS changed_window, {rounded('ni')} AS netMHCpan_window_improvement, {rounded('fi')} AS MHCflurry_window_improvement,
bp::int - wbp::int AS both_pass_change_vs_WT, ep::int - wep::int AS either_pass_change_vs_WT FROM rel""",
        "wt_scores_mhci": WT_SCORES,
        "wt_scores_mhcii": f"""WITH {FRAG2}, {mhcii()}, {mhcii("two_wt", "frag_wt")}, {LABELS},
rel AS (SELECT v.allele, v.variant_id, VR_mutation, w.peptide AS wp, v.peptide <> w.peptide AS changed, v.netMHCIIpan_EL_rank_binder AS b, w.netMHCIIpan_EL_rank_binder AS wb,
  CASE WHEN v.peptide = w.peptide THEN 0 ELSE w.netMHCIIpan_EL_rank - v.netMHCIIpan_EL_rank END AS i
  FROM two v LEFT JOIN two_wt w USING (allele, start, "end", k) LEFT JOIN labels l ON l.variant_id = v.variant_id)
SELECT allele, variant_id, min(VR_mutation) AS VR_mutation, max({COUNT})::bigint AS mutation_count, count(wp) AS matched_window_count, (SELECT count(*) FROM frag_wt) AS expected_window_count,
count(*) FILTER (WHERE changed) AS changed_window_count, count(*) FILTER (WHERE b AND NOT wb) AS netMHCIIpan_new_binder_count, count(*) FILTER (WHERE NOT b AND wb) AS netMHCIIpan_lost_binder_count,
count(*) FILTER (WHERE b) - count(*) FILTER (WHERE wb) AS netMHCIIpan_net_binder_change, {rounded('avg(i)')} AS netMHCIIpan_mean_window_improvement FROM rel GROUP BY 1, 2""",
        "mutation_recurrence": f"WITH {BOTH}, {SCORES}, {MUTATIONS} SELECT allele, mutation, count(*) AS n_variants_with_mutation FROM mut GROUP BY 1, 2 HAVING count(*) >= 5",
        "mutation_gram": f"""WITH {DESIGN} SELECT allele, outcome, a.m AS a, b.m AS b, count(*) AS xtx, CASE WHEN b.m = '' THEN {rounded('sum(value)')} END AS xty
FROM y JOIN x a USING (allele, variant_id) JOIN x b USING (allele, variant_id) GROUP BY 1, 2, 3, 4""",
        "mutation_residuals": f"WITH {DESIGN} SELECT allele, outcome, m AS mutation, count(*) AS n_variants, 0::double AS residual FROM y JOIN x USING (allele, variant_id) GROUP BY 1, 2, 3",
        "mutation_fit_sums": f"""WITH {DESIGN} SELECT allele, outcome, count(*) AS n_variants, any_value(n) AS n_mutations, any_value(n) + 1 AS design_columns, {rounded('var_pop(value) * count(*)')} AS tss, 0::double AS gap
FROM y JOIN (SELECT allele, count(*) AS n FROM keep GROUP BY 1) USING (allele) GROUP BY 1, 2""",
        "bootstrap_draws": f"WITH {DESIGN} SELECT allele, outcome, r::int AS replicate, n AS n_rows, n AS n_drawn FROM (SELECT allele, outcome, count(*) AS n FROM y GROUP BY 1, 2), range(500) AS t(r)",
        "parsed_mutations": f"""WITH {LIBRARY}, {LABELS}, {PARSED_OK} SELECT *, {rounded(_scale(hydrophobicity, "mutant_aa") + " - " + _scale(hydrophobicity, "wt_aa"))} AS hydrophobicity_change,
{rounded(_scale(volume, "mutant_aa") + " - " + _scale(volume, "wt_aa"))} AS volume_change,
{rounded(_scale(charge, "mutant_aa") + " - " + _scale(charge, "wt_aa"))} AS charge_change FROM parsed""",
        "allele_iqr": f"WITH {COEFFICIENTS} {SUMMARY}",
        "top_iqr": f"WITH {COEFFICIENTS} SELECT outcome, rank::int AS rank, mutation, allele_iqr FROM (SELECT *, row_number() OVER (PARTITION BY outcome ORDER BY allele_iqr DESC NULLS LAST, mutation) AS rank FROM ({SUMMARY})) WHERE rank <= 5",
        "allele_correlation": f"""WITH {COEFFICIENTS} SELECT a.outcome, a.allele AS allele_a, b.allele AS allele_b, count(*) AS n_common, CASE WHEN count(*) >= 3 THEN {rounded('corr(a.x, b.x)')} END AS pearson_r
FROM coef a JOIN coef b USING (outcome, mutation) GROUP BY 1, 2, 3""",
        "allele_pivot": f"WITH {COEFFICIENTS} SELECT outcome, mutation, {', '.join(f"avg(x) FILTER (WHERE allele = '{a}') AS {a}" for a in fx.NATION_ALLELES)} FROM coef GROUP BY 1, 2",
        "mutation_effects": f"""WITH {COEFFICIENTS} SELECT outcome, mutation, wt_aa, mutant_aa, position_relative, position_absolute, {QUARTILES.format(m="median_allele_coefficient")},
count(DISTINCT allele) AS n_alleles, count(*) FILTER (WHERE st >= 0.5) AS n_supported_alleles, round(count(*) FILTER (WHERE st >= 0.5) / count(DISTINCT allele), 6) AS support_fraction FROM coef GROUP BY 1, 2, 3, 4, 5, 6""",
        "heatmap_cells": f"WITH {COEFFICIENTS} SELECT allele, outcome, mutant_aa, position_relative, x AS effect, st >= 0.5 AS stable FROM coef",
    }
    return out
