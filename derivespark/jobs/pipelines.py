"""Whole derivations: subject, findings, time-to-event, occurrence and laboratory datasets."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import dates, joins, project, records, windows

SUBJECT = ["STUDYID", "USUBJID"]
AGE_BREAKS, AGE_LABELS = [0, 18, 65, 200], ["<18", "18-64", ">=65"]


#: The visits whose completion is flagged, and the doses of the titrated arm between visits.
COMPLETION = {"COMP8FL": 8, "COMP16FL": 10, "COMP24FL": 12}
TITRATED_ARM, TITRATION = 2, ["54", "81", "54"]
MINI_MENTAL, ADAS_COG, CIBIC = "MINI-MENTAL STATE", "ADAS-COG", "CIBIC+"


#: Term and visit by which completion is known, groups of disposition, upper ends of the coded age groups, the
#: code of pooled sites and the fewest subjects of a site in an arm.
COMPLETED_TERM, LATE_VISIT, LAST_VISIT = "PROTCOL COMPLETED", 13, 12
REASONS = {"WITHDRAWAL BY SUBJECT": "Withdrew Consent", "STUDY TERMINATED BY SPONSOR": "Sponsor Decision", "PROTOCOL ENTRY CRITERIA NOT MET": "I/E Not Met", "LOST TO FOLLOW-UP": "Lost to Follow-up"}
OLD, OLDEST = 65, 80
POOLED_SITE, SITE_LEAST = "900", 3


def build_adsl(
    dm: DataFrame, ex: DataFrame, vs: DataFrame, codelists: Mapping[str, DataFrame], *, qs: DataFrame | None = None, sv: DataFrame | None = None, ds: DataFrame | None = None,
    mh: DataFrame | None = None, sc: DataFrame | None = None, reasons: Mapping[str, str] = REASONS, site_least: int = SITE_LEAST,
) -> DataFrame:
    """A row per subject: planned and actual treatment, first and last dose, age at first dose (from BRTHDT, if collected), age
    groups, coded race, pooled site, baseline height (visit 1), weight (visit 3), body-mass index and its group; with
    questionnaires, visits, disposition, history and characteristics also the populations and completion flags, the
    mental-state sum, the doses taken, disposition, duration of disease and education.

    All that is taken from one source is one aggregate and one join (``joins.merge_all``). The last dose date is that of the
    last record; where it is missing and the subject discontinued after visit 3, the date of discontinuation. ``reasons``
    groups terms of disposition; another term is written with a capital.
    """
    if "SITEID" in dm.columns and "ARM" in dm.columns:
        dm = joins.pool_groups(dm, "SITEGR1", "SITEID", "ARM", site_least, POOLED_SITE)
    dosed = dates.impute_dtc(ex, "EXSTDTM", "EXSTDTC", output="dtm", time_imputation="first")
    dosed = dates.impute_dtc(dosed, "EXENDTM", "EXENDTC", output="dtm", date_imputation="last", time_imputation="last")
    out = joins.merge_all(dm, dosed, SUBJECT, [
        joins.Pick({"TRTSDTM": "EXSTDTM", "TRTSDTF": "EXSTDTF", "TRTSTMF": "EXSTTMF"}, ["EXSTDTM"], "first", "EXDOSE > 0 AND EXSTDTM IS NOT NULL"),
        joins.Pick({"TRTEDTM": "EXENDTM"}, ["EXENDTM"], "last", "EXDOSE > 0 AND EXENDTM IS NOT NULL"),
    ])
    out = out.transform(dates.dtm_to_dt, "TRTSDTM").transform(dates.dtm_to_dt, "TRTEDTM")
    if ds is not None:
        out = _disposition(out, ds, reasons)
    out = dates.duration(out, "TRTDURD", "TRTSDT", "TRTEDT", "days", add_one=True)
    if "ARM" in dm.columns:
        out = project.assign(out, "TRT01P", from_="ARM").transform(project.assign, "TRT01A", from_="ARM")
    if "TRT01PN" in dm.columns:
        out = project.assign(out, "TRT01AN", from_="TRT01PN")
    at = lambda code, visit: f"VSTESTCD = '{code}' AND VISITNUM = {visit}"
    out = joins.merge_all(out, vs, SUBJECT, [
        joins.Pick({"HEIGHTBL": "VSSTRESN"}, ["VSSTRESN"], "first", at("HEIGHT", 1)), joins.Pick({"WEIGHTBL": "VSSTRESN"}, ["VSSTRESN"], "first", at("WEIGHT", 3)),
    ])
    out = project.compute_var(out, "BMIBL", "try_divide(WEIGHTBL, pow(HEIGHTBL / 100, 2))")
    out = project.compute_var(out, "BMIBLGR1", "CASE WHEN BMIBL < 25 THEN '<25' WHEN BMIBL < 30 THEN '25-<30' WHEN BMIBL >= 30 THEN '>=30' END")
    if "BRTHDT" in dm.columns:
        out = dates.duration(out, "AGE", "BRTHDT", "TRTSDT", "years")
    out = project.categorize(out, "AGEGR1", "AGE", AGE_BREAKS, AGE_LABELS, right=False)
    out = project.compute_var(out, "AGEGR1N", f"CASE WHEN AGE < {OLD} THEN 1 WHEN AGE <= {OLDEST} THEN 2 WHEN AGE > {OLDEST} THEN 3 END")
    out = project.codelist_var(out, "RACEN", "RACE", codelists["RACE"])
    if qs is not None:
        out = _populations(out, qs)
    if sv is not None:
        out = _exposure(out, sv, mh)
    if sc is not None:
        out = joins.merge_all(out, sc, SUBJECT, [joins.Pick({"EDUCLVL": "SCSTRESN"}, ["SCSTRESN"], "first", "SCTESTCD = 'EDLEVEL'")])
    return out


def _disposition(out: DataFrame, ds: DataFrame, reasons: Mapping[str, str]) -> DataFrame:
    """Term, grouped reason, flags and status of disposition, the visit of completion; the last dose date where missing."""
    left = dates.impute_dtc(ds, "DISCDT", "DSSTDTC")
    wanted = [joins.Pick({"DISCDT": "DISCDT"}, ["DISCDT"], "first", "DSDECOD <> 'COMPLETED' AND VISITNUM > 3 AND DISCDT IS NOT NULL")]
    if "DSCAT" in ds.columns:
        wanted.append(joins.Pick({"DCDECOD": "DSDECOD"}, ["DISCDT", "VISITNUM"], "first", "DSCAT = 'DISPOSITION EVENT'"))
    if "DSTERM" in ds.columns:
        wanted.append(joins.Pick({"VISNUMEN": "VISITNUM"}, ["VISITNUM"], "last", f"DSTERM = '{COMPLETED_TERM}'"))
    out = project.compute_var(joins.merge_all(out, left, SUBJECT, wanted), "TRTEDT", "coalesce(TRTEDT, DISCDT)")
    if "DSTERM" in ds.columns:
        out = project.compute_var(out, "VISNUMEN", f"CASE WHEN VISNUMEN = {LATE_VISIT} THEN {LAST_VISIT} ELSE VISNUMEN END")
    if "DSCAT" in ds.columns:
        named = F.create_map(*[F.lit(x) for pair in reasons.items() for x in pair]) if reasons else None
        plain = F.concat(F.upper(F.substring("DCDECOD", 1, 1)), F.lower(F.substring("DCDECOD", 2, 1_000_000)))
        out = project.compute_var(out, "DCSREAS", F.coalesce(named[F.col("DCDECOD")], plain) if reasons else plain)
        out = project.assign_conditional(out, "DISCONFL", "DCDECOD <> 'COMPLETED'", "Y")
        out = project.assign_conditional(out, "DSRAEFL", "DCDECOD = 'ADVERSE EVENT'", "Y")
        out = project.compute_var(out, "EOSSTT", "CASE WHEN DCDECOD = 'COMPLETED' THEN 'COMPLETED' WHEN DCDECOD IS NOT NULL THEN 'DISCONTINUED' END")
    return out


def _populations(out: DataFrame, qs: DataFrame) -> DataFrame:
    """Flags of the intended, safety and efficacy populations, and the sum of the mental-state answers."""
    out = project.assign_conditional(out, "ITTFL", "ARMCD <> ''", "Y", "N")
    out = project.assign_conditional(out, "SAFFL", "ITTFL = 'Y' AND TRTSDT IS NOT NULL", "Y", "N")
    out = joins.merge_all(out, qs, SUBJECT, [
        *[joins.Exists(name, f"QSCAT = '{category}' AND VISITNUM > 3") for name, category in (("_adas", ADAS_COG), ("_cibic", CIBIC))],
        joins.Summary("MMSETOT", F.sum, "try_cast(QSORRES AS DOUBLE)", f"QSCAT = '{MINI_MENTAL}'"),
    ])
    return project.assign_conditional(out, "EFFFL", "SAFFL = 'Y' AND _adas = 'Y' AND _cibic = 'Y'", "Y", "N").drop("_adas", "_cibic")


def _exposure(out: DataFrame, sv: DataFrame, mh: DataFrame | None) -> DataFrame:
    """Visit dates, completion flags, cumulative and average dose, months since onset and their group."""
    seen = dates.impute_dtc(sv, "SVSTDT", "SVSTDTC")
    out = dates.impute_dtc(out, "RFENDT", "RFENDTC", date_imputation="last")
    visits = [joins.Pick({name: "SVSTDT"}, ["SVSTDT"], "first", f"VISITNUM = {n} AND SVSTDT IS NOT NULL") for name, n in (("VISIT1DT", 1), ("VISIT4DT", 4), ("VISIT12DT", 12))]
    out = joins.merge_all(out, seen, SUBJECT, [*visits, *[joins.Exists(flag, f"VISITNUM = {n}", ("SVSTDT", "RFENDT")) for flag, n in COMPLETION.items()]])
    out = dates.date_shift(dates.date_shift(out, "_after4", "VISIT4DT", 1), "_after12", "VISIT12DT", 1)
    out = records.interval_dose(out, "_titrated", ["TRTSDT", "_after4", "_after12"], TITRATION, "TRTEDT")
    out = project.compute_var(out, "CUMDOSE", F.when(F.col("ARMN") == TITRATED_ARM, F.col("_titrated")).otherwise(F.col("TRT01PN") * F.col("TRTDURD")))
    out = project.compute_var(out, "AVGDD", "try_divide(CUMDOSE, TRTDURD)").drop("_after4", "_after12", "_titrated")
    if mh is not None:
        began = dates.impute_dtc(mh, "DISONSDT", "MHSTDTC", highest_imputation="M")
        out = joins.merge_all(out, began, SUBJECT, [joins.Pick({"DISONSDT": "DISONSDT"}, ["DISONSDT"], "first", "MHCAT = 'PRIMARY DIAGNOSIS'")])
        out = dates.duration(out, "DURDIS", "DISONSDT", "VISIT1DT", "months")
        out = project.compute_var(out, "DURDSGR1", "CASE WHEN DURDIS < 12 THEN '<12' WHEN DURDIS >= 12 THEN '>=12' END")
    return out


def build_findings(rows: DataFrame, subjects: DataFrame, lookup: DataFrame, *, prefix: str) -> DataFrame:
    """A row per record: parameter, value, baseline flag and value, change. Flag and base share one shuffle."""
    out = dates.impute_dtc(rows, "ADTM", f"{prefix}DTC", output="dtm", time_imputation="first").transform(dates.dtm_to_dt, "ADTM")
    out = joins.merge_var(out, subjects, "TRTSDTM", "TRTSDTM", SUBJECT)
    out = project.to_bds(out, f"{prefix}TESTCD", f"{prefix}STRESN")
    out = joins.lookup_join(out, lookup, "PARAM", "PARAM", [f"{prefix}TESTCD"])
    keys = [*SUBJECT, "PARAMCD"]
    out = windows.extreme_flag(out, "ABLFL", keys, ["ADTM", f"{prefix}SEQ"], "last", restrict="ADTM <= TRTSDTM AND AVAL IS NOT NULL")
    out = joins.derive_base(out, keys)
    out = project.compute_var(out, "CHG", "AVAL - BASE")
    out = project.compute_var(out, "PCHG", "try_divide(100 * (AVAL - BASE), BASE)")
    return dates.study_day(out, "ADY", "ADT", "TRTSDTM")


#: Collected visit names that the analysis names otherwise; limits of the normal range by parameter.
VISITS = {"SCREENING 1": "SCREENING"}
RANGES = {"SYSBP": (90, 140)}


def build_advs(vs: DataFrame, subjects: DataFrame, lookup: DataFrame, ranges: Mapping[str, tuple[float, float]] = RANGES) -> DataFrame:
    """Findings with unit, visit and, for the parameters in ``ranges``, LOW below the range, HIGH above it, else NORMAL."""
    out = build_findings(vs, subjects, lookup, prefix="VS")
    if "VSSTRESU" in vs.columns:
        out = project.assign(out, "AVALU", from_="VSSTRESU")
    if "VISIT" in vs.columns:
        renamed = F.create_map(*[F.lit(x) for pair in VISITS.items() for x in pair])
        out = project.compute_var(out, "AVISIT", F.coalesce(renamed[F.col("VISIT")], F.col("VISIT")))
    indicator = F.lit(None).cast("string")
    for code, (low, high) in ranges.items():
        mine = (F.col("PARAMCD") == code) & F.col("AVAL").isNotNull()
        indicator = F.when(mine & (F.col("AVAL") < low), "LOW").when(mine & (F.col("AVAL") > high), "HIGH").when(mine, "NORMAL").otherwise(indicator)
    return project.compute_var(out, "ANRIND", indicator)


def build_adlbc(lb: DataFrame, subjects: DataFrame, lookup: DataFrame, limits: tuple[float, float] = (0.5, 1.5)) -> DataFrame:
    """Findings with ratios to the normal range, range indicators of value and baseline (L below the first multiple of the
    lower limit, H above the second of the upper one, else N; the text of the rule has one half for both limits, which
    would call most normal values high: pass ``limits=(0.5, 0.5)`` for it to the letter), the extreme-value flag, the visit, and the last record or
    end-of-treatment flag."""
    out = build_findings(lb, subjects, lookup, prefix="LB")
    out = out.withColumns({"A1LO": F.col("LBSTNRLO").cast("double"), "A1HI": F.col("LBSTNRHI").cast("double")})
    out = project.compute_var(out, "R2A1LO", "try_divide(AVAL, A1LO)")
    out = project.compute_var(out, "R2A1HI", "try_divide(AVAL, A1HI)")
    keys = [*SUBJECT, "PARAMCD"]
    out = joins.derive_base(out, keys, "BR2A1LO", "R2A1LO")
    out = joins.derive_base(out, keys, "BR2A1HI", "R2A1HI")
    low, high = limits
    out = project.compute_var(out, "ALBTRVAL", f"greatest(AVAL - {high} * A1HI, {low} * A1LO - AVAL)")
    for target, value in (("ANRIND", "AVAL"), ("BNRIND", "BASE")):
        out = project.compute_var(out, target, f"CASE WHEN {value} < {low} * A1LO THEN 'L' WHEN {value} > {high} * A1HI THEN 'H' WHEN {value} IS NOT NULL THEN 'N' END")
    if "VISIT" in lb.columns:
        out = project.assign(out, "AVISIT", from_="VISIT")
    out = project.assign(out, "AVISITN", from_="VISITNUM")
    out = windows.max_value_flag(out, "ANL01FL", keys, "ALBTRVAL")
    return windows.last_or_visit_flag(out, "AENTMTFL", keys, ["VISITNUM", "LBSEQ"], "VISITNUM", 12)


def build_adtte(subjects: DataFrame, ae: DataFrame) -> DataFrame:
    """Days from first treatment to the earliest event that is treatment-emergent, that is not before it; NULL, and
    censored, without one."""
    events = dates.impute_dtc(ae, "ASTDTM", "AESTDTC", output="dtm", time_imputation="first")
    events = joins.merge_var(events, subjects, "TRTSDTM", "TRTSDTM", SUBJECT)
    out = joins.merge_var(subjects, events, "EVENTDTM", "ASTDTM", SUBJECT, "first", ["ASTDTM"], "ASTDTM >= TRTSDTM")
    out = dates.duration(out, "AVAL", "TRTSDTM", "EVENTDTM", "days")
    return out.withColumns({"PARAMCD": F.lit("TTE"), "CNSR": F.when(F.col("EVENTDTM").isNull(), 1).otherwise(0)})


#: Terms and body system of skin events.
SKIN_EVENT = "DERMATOLOGIC EVENTS"
SKIN_WORDS = ["APPLICATION", "DERMATITIS", "ERYTHEMA", "BLISTER"]
SKIN_SYSTEM, SKIN_BUT = "SKIN AND SUBCUTANEOUS TISSUE DISORDERS", ["COLD SWEAT", "HYPERHIDROSIS", "ALOPECIA"]


def build_adae(ae: DataFrame, adsl: DataFrame, carried: Sequence[str] = ("TRTSDT", "TRTEDT"), words: Sequence[str] = SKIN_WORDS, system: str = SKIN_SYSTEM) -> DataFrame:
    """Events with subject columns in one merge, dates, days they last, treatment-emergent flag, skin events (terms with
    one of ``words``, or of the body ``system``) and the first-occurrence flags. The events are dealt by subject once, which
    serves all windows."""
    out = joins.merge_vars(ae, adsl, {c: c for c in carried}, SUBJECT)
    out = dates.impute_dtc(out, "ASTDT", "AESTDTC").transform(lambda d: dates.impute_dtc(d, "AENDT", "AEENDTC", date_imputation="last"))
    out = dates.study_day(out, "ASTDY", "ASTDT", "TRTSDT").transform(lambda d: dates.study_day(d, "AENDY", "AENDT", "TRTSDT"))
    out = project.compute_var(out, "ADURN", "datediff(AENDT, ASTDT) + 1")
    out = project.keyword_flag(out, "CQ01NAM", SKIN_EVENT, contains={"AEDECOD": words}, equals={"AEBODSYS": [system]}, exclude={"AEDECOD": SKIN_BUT})
    out = project.assign_conditional(out, "TRTEMFL", "ASTDT >= TRTSDT", "Y").repartition("USUBJID")
    order, treated = ["ASTDT", "AESEQ"], "TRTEMFL = 'Y'"
    flags = {
        "AOCCFL": (SUBJECT, treated),
        "AOCCSFL": ([*SUBJECT, "AEBODSYS"], treated),
        "AOCCPFL": ([*SUBJECT, "AEBODSYS", "AEDECOD"], treated),
        "AOCC01FL": (SUBJECT, f"{treated} AND CQ01NAM IS NOT NULL"),
        "AOCC02FL": (SUBJECT, f"{treated} AND AESER = 'Y'"),
        "AOCC03FL": ([*SUBJECT, "AEBODSYS"], f"{treated} AND AESER = 'Y'"),
        "AOCC04FL": ([*SUBJECT, "AEBODSYS", "AEDECOD"], f"{treated} AND AESER = 'Y'"),
    }
    for target, (by, restrict) in flags.items():
        out = windows.extreme_flag(out, target, by, order, "first", restrict=restrict)
    return out
