"""Schemas of the engine's tables."""

from __future__ import annotations

PAIR = "struct<lo:double,hi:double>"
PROBLEMS = (
    "id string, model_name string, original_formula string, generation_formula string, simp_formula string, target string, variables array<string>, params array<struct<name:string,lo:double,hi:double>>, "
    f"constants map<string,double>, constant_order array<string>, para_values array<array<double>>, var_ranges array<array<{PAIR}>>, target_ranges array<{PAIR}>"
)
SAMPLES = "variant string, id string, grp int, row_idx long, x map<string,double>, y double"
CANDIDATES = "id string, dataset int, complexity int, loss double, score double, equation string, para_eq string, para_list array<string>, orgpara_list array<double>, feature_name_map map<string,string>, src_row long"
FITS = "id string, formula_id string, variant string, grp int, ok boolean, mse double, nmse double, r2 double, params array<double>, attempts int, retry_used boolean, error string"
SHARED_METRICS = ("mse", "mse_hmean", "mse_rms", "r2", "r2_hmean", "r2_rms")
RANKING = (
    "ID", "TopRank", "ModelName", "OriginalFormula", "GenerationFormula", "Target", "IndependentVars", "ParameterRange", "FixedConstantValues", "simpFormula", "para_eq",
    "orgpara_list", "para_list", "shared_fit_mse_0_7", "shared_fit_mse_hmean_0_7", "shared_fit_r2_0_7", "complexity", "loss", "score", "dataset", "fromdataset", "SourceFolder",
)
