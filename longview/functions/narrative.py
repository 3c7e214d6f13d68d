"""Templated summary sentences, provenance and display lines."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import fixed1, half_even

# Report wording.
DISCLAIMER = "Research prototype on NLST data. Not a medical device; not for clinical use."
ROUND_NAMES = {"T0": "the baseline scan", "T1": "the first annual follow-up", "T2": "the second annual follow-up"}
NO_MODEL = ("No risk estimate was produced: the risk model is not installed in this deployment, "
            "so this report covers tissue change only.")
NO_ESTIMATE = "No risk estimate was produced for this scan."
NOT_CALIBRATED = ". The score is the model's own output, not yet recalibrated on this cohort"
DEFORMABLE_CAVEAT = ("Deformable registration did not complete for this pair, so differences caused by breathing "
                     "may not be fully removed.")
FAILED_NOTE = ("Registration failed: no stage aligned these rounds better than leaving them unregistered, "
               "so no change regions are reported for this pair.")
INVALID_CURVE = "invalid risk curve: "
NO_SCORE = "no risk score was given for this patient"
ONE_ROUND_NOTE = "Only one screening round is available, so there is nothing to compare."


def percent(c: Column) -> Column:
    return F.concat(fixed1(c * 100.0), F.lit("%"))


def whole(c: Column) -> Column:
    """No decimals, halves to even, keeping the sign of a negative zero."""
    n = half_even(c, 0).cast("bigint")
    return F.concat(F.when((n == 0) & (c < 0), "-").otherwise(""), n.cast("string"))


def describe_round(label: Column) -> Column:
    named = F.element_at(F.create_map(*[F.lit(x) for kv in ROUND_NAMES.items() for x in kv]), label)
    return F.coalesce(named, F.when(F.length(label) > 0, label), F.lit("an earlier round"))


def capitalise(c: Column) -> Column:
    return F.concat(F.upper(F.substring(c, 1, 1)), F.lower(F.substr(c, F.lit(2))))


# Fixed wording: the parts of the sentences that the functions below put together.
def risk_sentence(available: Column, year_1: Column, percentile: Column, calibrated: Column,
                  ci_lo: Column | None = None, ci_hi: Column | None = None) -> Column:
    none = F.lit(None).cast("double")
    lo, hi = (ci_lo, ci_hi) if ci_lo is not None and ci_hi is not None else (none, none)
    interval = F.when(lo.isNotNull() & hi.isNotNull(),
                      F.concat(F.lit(" (interval "), percent(lo), F.lit("–"), percent(hi), F.lit(")"))).otherwise("")
    place = F.when(
        percentile.isNotNull(),
        F.concat(F.lit(", "), F.when(percentile >= 50, "above").otherwise("below"),
                 F.lit(" the median for this screening cohort ("), percentile.cast("string"), F.lit("th percentile)")),
    ).otherwise("")
    note = F.when(F.coalesce(calibrated, F.lit(False)), "").otherwise(NOT_CALIBRATED)
    text = F.concat(F.lit("Estimated 1-year lung-cancer risk is "), percent(year_1), interval, place, note, F.lit("."))
    return F.when(~F.coalesce(available, F.lit(False)), NO_MODEL).when(year_1.isNull(), NO_ESTIMATE).otherwise(text)


def horizon_sentence(available: Column, curve: Column) -> Column:
    ok = F.coalesce(available, F.lit(False)) & (F.size(curve) >= 6)
    return F.when(ok, F.concat(F.lit("Cumulative risk rises to "), percent(F.try_element_at(curve, F.lit(-1))), F.lit(" by year 6."))).otherwise("")


def attention_sentence(top_slices: Column) -> Column:
    listed = F.array_join(F.transform(F.slice(top_slices, 1, 3), lambda s: s.cast("string")), ", ")
    return F.when(
        F.size(top_slices) > 0,
        F.concat(F.lit("The model weighted slices "), listed,
                 F.lit(" most heavily; these show where it attended, which is not by itself evidence of disease.")),
    ).otherwise("")


def pair_sentence(pair: Column) -> Column:
    """One sentence for one compared pair of rounds.

    ``pair`` has from_round, to_round, registration_failed, n_regions and top,
    the best-ranked region (kind, side, delta_mm, baseline_hu, followup_hu, slice).
    """
    earlier, later = describe_round(pair["from_round"]), describe_round(pair["to_round"])
    top, n = pair["top"], F.coalesce(pair["n_regions"], F.lit(0))
    verb = F.when(top["kind"] == "new", "appeared where none was visible before").otherwise("enlarged")
    opening = F.concat(F.lit("Comparing "), later, F.lit(" with "), earlier, F.lit(", "))
    found = F.concat(
        opening, n.cast("string"), F.lit(" candidate region"), F.when(n != 1, "s").otherwise(""),
        F.lit(" met the thresholds. The largest, about "), whole(top["delta_mm"]), F.lit(" mm across in the "), top["side"],
        F.lit(" lung, "), verb, F.lit(" (density "), whole(top["baseline_hu"]), F.lit(" to "), whole(top["followup_hu"]),
        F.lit(" HU, slice "), top["slice"].cast("string"), F.lit(")."),
    )
    failed = F.concat(capitalise(later), F.lit(" could not be aligned with "), earlier,
                      F.lit(", so no change regions are reported for that comparison."))
    return (F.when(F.coalesce(pair["registration_failed"], F.lit(False)), failed)
            .when(n == 0, F.concat(opening, F.lit("no region met the change thresholds."))).otherwise(found))


def change_sentence(pairs: Column) -> Column:
    return F.coalesce(F.array_join(F.transform(pairs, pair_sentence), " "), F.lit(""))


def registration_caveat(pairs: Column) -> Column:
    weak = F.exists(pairs, lambda p: ~F.coalesce(p["registration_failed"], F.lit(False)) & (p["deformable"] == F.lit(False)))
    return F.when(F.coalesce(weak, F.lit(False)), DEFORMABLE_CAVEAT).otherwise("")


def compose(*sentences: Column) -> Column:
    """Join the sentences that say something and close with the disclaimer."""
    said = F.filter(F.array(*sentences), lambda s: F.length(s) > 0)
    return F.trim(F.concat(F.array_join(said, " "), F.lit(" " + DISCLAIMER)))


def stamp(model: Column, code_rev: str, generated_at: str, **extra: Column) -> Column:
    """What produced a result. Revision and time are parameters, so re-runs agree."""
    return F.struct(
        model.alias("model"), F.lit(code_rev).alias("code_rev"), F.lit(generated_at).alias("generated_at"),
        F.lit(True).alias("research_only"), F.lit(DISCLAIMER).alias("disclaimer"),
        *[v.alias(k) for k, v in extra.items()],
    )
