"""Cox proportional hazards with Efron ties, fitted by Newton steps of one Spark job each.

A step sums risk, covariates and their products per day; days are few, so the running sums
over later days are small windows. One row with the likelihood, score and information comes
back to the driver, where a p x p system is solved (p covariates, tens at most).
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortmill.functions import fixed
from cohortmill.functions.clinical import with_model_columns
from cohortmill.functions.probability import two_sided_p
from cohortmill.operators.concordance import concordance_index
from cohortmill.operators.survival import Z95, panel_z_scores
from cohortmill.session import materialize

TIES_PER_ROW = 4096


class NotConverged(RuntimeError):
    pass


@dataclass
class CoxFit:
    covariates: list[str]
    dropped: list[str]
    coefficients: np.ndarray
    covariance: np.ndarray
    log_likelihood: float
    penalizer: float
    iterations: int
    n: int
    n_events: int


def _pairs(p: int) -> list[tuple[int, int]]:
    return [(i, j) for i in range(p) for j in range(i, p)]


def moments(rows: DataFrame, p: int, beta: Sequence[float]) -> DataFrame:
    """One row: partial log-likelihood ll, score u* and information i* at ``beta`` (Efron).

    ``rows`` has time, event and x0, x1, ... The sums per day are one partial aggregate; the
    running sums over later days and the tie terms work on the day table. A day with many
    deaths is cut into short runs of tied deaths that are spread over the tasks.
    """
    weights = {"0": "r"}
    weights.update({f"1_{i}": f"r * x{i}" for i in range(p)})
    weights.update({f"2_{i}_{j}": f"r * x{i} * x{j}" for i, j in _pairs(p)})
    eta = " + ".join(f"x{i} * {float(b)!r}D" for i, b in enumerate(beta))
    return rows.sparkSession.sql(f"""
      with subject as (
        select *, exp(eta) as r, cast(event as double) as dead
        from (select *, {eta} as eta from {{rows}})),
      day as (
        select time, sum(cast(event as bigint)) as d, sum(dead * eta) as de,
          {', '.join(f"sum(dead * x{i}) as dx{i}" for i in range(p))},
          {', '.join(f"sum({w}) as p{k}, sum(dead * {w}) as d{k}" for k, w in weights.items())}
        from subject group by time),
      at_risk as (
        select *, {', '.join(f"sum(p{k}) over w as s{k}" for k in weights)}
        from day window w as (order by time desc)),
      run as (
        select /*+ REPARTITION(time, run) */ *
        from (select *, explode(sequence(0L, d - 1, {TIES_PER_ROW}L)) as run
              from at_risk where d > 0)),
      tie as (
        select *, explode(sequence(run, least(run + {TIES_PER_ROW - 1}L, d - 1))) as l from run),
      term as (
        select if(l = 0, de, 0D) as de,
          {', '.join(f"if(l = 0, dx{i}, 0D) as dx{i}" for i in range(p))},
          {', '.join(f"s{k} - l / d * d{k} as a{k}" for k in weights)}
        from tie)
      select sum(de - ln(a0)) as ll,
        {', '.join(f"sum(dx{i} - a1_{i} / a0) as u{i}" for i in range(p))},
        {', '.join(f"sum(a2_{i}_{j} / a0 - a1_{i} * a1_{j} / (a0 * a0)) as i{i}_{j}"
                   for i, j in _pairs(p))}
      from term""", rows=rows)


def _unpack(row, p: int) -> tuple[float, np.ndarray, np.ndarray]:
    u = np.array([row[f"u{i}"] for i in range(p)], dtype=float)
    info = np.zeros((p, p))
    for i, j in _pairs(p):
        info[i, j] = info[j, i] = row[f"i{i}_{j}"]
    return float(row["ll"]), u, info


def scaled_rows(rows: DataFrame, covariates: Sequence[str], time: str = "time",
                event: str = "event") -> tuple[DataFrame, list[str], list[str], np.ndarray, int, int]:
    """Complete cases with covariates centred and scaled to x0, x1, ...; constant ones dropped.

    Scaling keeps the exponentials in range and is undone on the coefficients.
    """
    rows = rows.where(F.col(time).isNotNull() & F.col(event).isNotNull()).dropna(
        subset=list(covariates))
    stats = rows.agg(
        F.count("*").alias("n"), F.sum(F.col(event).cast("int")).alias("d"),
        *[f(F.col(c).cast("double")).alias(f"{label}_{c}")
          for c in covariates
          for label, f in (("m", F.avg), ("s", F.stddev_samp), ("lo", F.min), ("hi", F.max))],
    ).first()
    used = [c for c in covariates if stats[f"lo_{c}"] != stats[f"hi_{c}"]]
    dropped = [c for c in covariates if c not in used]
    scale = np.array([stats[f"s_{c}"] for c in used], dtype=float)
    scaled = rows.select(
        F.col(time).alias("time"), F.col(event).alias("event"),
        *[((F.col(c).cast("double") - F.lit(stats[f"m_{c}"])) / F.lit(stats[f"s_{c}"])).alias(f"x{i}")
          for i, c in enumerate(used)],
    )
    return scaled, used, dropped, scale, stats["n"], int(stats["d"] or 0)


def _newton(scaled: DataFrame, p: int, n: int, penalizer: float, start: np.ndarray,
            steps: int = 50, tolerance: float = 1e-9) -> tuple[np.ndarray, np.ndarray, float, int]:
    """Newton steps with halving; the ridge penalty is n * penalizer / 2 * |beta|^2."""
    def at(beta: np.ndarray):
        ll, u, info = _unpack(moments(scaled, p, beta).first(), p)
        ll -= n * penalizer / 2 * float(beta @ beta)
        return ll, u - n * penalizer * beta, info + n * penalizer * np.eye(p)

    beta = start
    ll, u, info = at(beta)
    for step in range(1, steps + 1):
        if not (math.isfinite(ll) and np.isfinite(info).all()):
            raise NotConverged("the likelihood is not finite")
        if np.linalg.cond(info) > 1e13:
            raise NotConverged("the information matrix is singular")
        move = np.linalg.solve(info, u)
        # the squared gain still to be had; small means the optimum is reached
        if float(u @ move) < 2 * tolerance:
            return beta + move, np.linalg.inv(info), ll + float(u @ move) / 2, step
        size = 1.0
        while True:
            trial = beta + size * move
            new = at(trial)
            if math.isfinite(new[0]) and new[0] >= ll - 1e-12 * abs(ll):
                break
            size /= 2
            if size < 1e-6:
                raise NotConverged("no step improves the likelihood")
        beta, (ll, u, info) = trial, new
        if np.abs(beta).max() > 50:
            raise NotConverged("coefficients run away")
    raise NotConverged(f"no convergence in {steps} steps")


def fit_cox(rows: DataFrame, covariates: Sequence[str], time: str = "time",
            event: str = "event", penalizers: Sequence[float] = fixed.RIDGE_STEPS,
            near: CoxFit | None = None) -> CoxFit:
    """Fits without penalty first; a fit that does not converge is tried with more ridge.

    ``near`` is a fit of a smaller model on the same rows to start from.
    """
    scaled, used, dropped, scale, n, d = scaled_rows(rows, covariates, time, event)
    if n < fixed.MIN_COX_ROWS:
        raise ValueError(f"too few complete rows for a Cox model: {n} < {fixed.MIN_COX_ROWS}")
    if not used or d == 0:
        raise ValueError("no covariate varies or no event occurs")
    scaled = materialize(scaled)  # read again by every step
    known = dict(zip(near.covariates, near.coefficients)) if near else {}
    start = np.array([known.get(c, 0.0) for c in used]) * scale
    problem: Exception | None = None
    for penalizer in penalizers:
        try:
            beta, covariance, ll, steps = _newton(scaled, len(used), n, penalizer, start)
        except (NotConverged, np.linalg.LinAlgError) as exc:
            problem = exc
            continue
        return CoxFit(used, dropped, beta / scale, covariance / np.outer(scale, scale), ll,
                      penalizer, steps, n, d)
    raise NotConverged(str(problem))


def effect_table(spark, fit: CoxFit, alpha: float = fixed.ALPHA) -> DataFrame:
    """Hazard ratios with 95 % limits, p, direction and a significance flag."""
    rows = [(c, float(b), float(math.sqrt(v)))
            for c, b, v in zip(fit.covariates, fit.coefficients, np.diag(fit.covariance))]
    table = spark.createDataFrame(rows, "covariate string, coef double, se double")
    half = F.lit(Z95) * F.col("se")
    return table.withColumns({
        "hr": F.exp("coef"), "ci_lower": F.exp(F.col("coef") - half),
        "ci_upper": F.exp(F.col("coef") + half), "z": F.col("coef") / F.col("se"),
    }).withColumn("p_value", two_sided_p(F.col("z"))).withColumns({
        "direction": F.when(F.col("hr") < 1, "protective").otherwise("risk"),
        "significant": F.col("p_value") < alpha,
    })


def with_risk(rows: DataFrame, fit: CoxFit, out: str = "risk") -> DataFrame:
    """Linear predictor per row; equal covariates give equal risks."""
    score = sum((F.lit(float(b)) * F.col(c).cast("double")
                 for b, c in zip(fit.coefficients, fit.covariates)), F.lit(0.0))
    return rows.withColumn(out, score)


CLINICAL_COVARIATES = ("age_at_index", "gender_male", "stage_numeric")


def model_rows(cohort: DataFrame) -> DataFrame:
    """Encoded cohort rows with a known main stage and complete clinical covariates."""
    encoded = with_model_columns(cohort)
    return encoded.where(F.col("stage_group").isin(*fixed.MAIN_STAGES)).dropna(
        subset=["time", "event", *CLINICAL_COVARIATES])


def _summary(fit: CoxFit, rows: DataFrame, label: str) -> DataFrame:
    index = concordance_index(with_risk(rows, fit), "risk")
    return index.select(
        F.lit(label).alias("model"), "c_index", F.lit(fit.penalizer).alias("penalizer"),
        F.lit(fit.n).cast("bigint").alias("n"), F.lit(fit.n_events).cast("bigint").alias("n_events"),
        F.lit(fit.log_likelihood).alias("log_likelihood"),
    )


def clinical_report(cohort: DataFrame, covariates: Sequence[str] = CLINICAL_COVARIATES
                    ) -> tuple[DataFrame, DataFrame]:
    """(effects, summary) of the clinical model: age, sex and stage."""
    rows = materialize(model_rows(cohort).select("time", "event", *covariates))
    fit = fit_cox(rows, covariates)
    return effect_table(cohort.sparkSession, fit), _summary(fit, rows, "clinical")


def panel_columns(expression: DataFrame, panel: Mapping[str, tuple[str, int]],
                  sample: str = "sample_id", **columns) -> tuple[DataFrame, list[str], list[str]]:
    """Panel z-scores as one column per symbol; z-scores use every sample.

    Returns the wide table, its columns and the symbols that are absent or constant.
    """
    z = materialize(panel_z_scores(expression, panel, sample=sample, **columns))
    present = {r[0] for r in z.select("symbol").distinct().collect()}  # panel-sized
    symbols = [s for s in panel if s in present]
    wide = z.groupBy(sample).pivot("symbol", symbols).agg(F.first("z"))
    names = {s: "g_" + s.replace("-", "_") for s in symbols}
    return (wide.withColumnsRenamed(names), [names[s] for s in symbols],
            [s for s in panel if s not in present])


def panel_report(cohort: DataFrame, expression: DataFrame,
                 panel: Mapping[str, tuple[str, int]] = fixed.SIGNATURE_PANEL,
                 sample: str = "sample_id", **columns) -> tuple[DataFrame, DataFrame, list[str]]:
    """(panel effects, summary of both models, missing symbols).

    The clinical model and the model with the panel are fitted on the same complete rows, so
    their concordance can be compared.
    """
    wide, genes, missing = panel_columns(expression, panel, sample, **columns)
    if not genes:
        raise ValueError("no panel feature is in the matrix")
    rows = model_rows(cohort).join(wide, sample).dropna(subset=genes)
    rows = materialize(rows.select("time", "event", *CLINICAL_COVARIATES, *genes))
    clinical = fit_cox(rows, CLINICAL_COVARIATES)
    full = fit_cox(rows, [*CLINICAL_COVARIATES, *genes], near=clinical)
    effects = effect_table(cohort.sparkSession, full).where(F.col("covariate").isin(*genes))
    summary = _summary(clinical, rows, "clinical").unionByName(_summary(full, rows, "panel"))
    return effects, summary, missing
