"""Scalar column expressions: costs, geometry, decisions, status."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from kinolake.functions.vectors import dot_columns, norm
from kinolake.settings import EDITOR, PROCESSING_STEPS, QUALITY_MULTIPLIERS, STORYBOARD

# Tolerances of the cost formulas.
STATIC_NORM = 1e-8
TINY_NORM = 1e-9


# -- motion costs ---------------------------------------------------------

def kinematic_cost(v_out: Sequence[Column], v_in: Sequence[Column],
                   w1: float = EDITOR.w1, w2: float = EDITOR.w2) -> Column:
    """Mismatch of direction and speed between an exit and an entry velocity."""
    n_out, n_in = norm(v_out), norm(v_in)
    direction = 1.0 - dot_columns(v_out, v_in) / (n_out * n_in + STATIC_NORM)
    speed = F.abs(n_out - n_in) / (F.greatest(n_out, n_in) + STATIC_NORM)
    static = (n_out < STATIC_NORM) & (n_in < STATIC_NORM)
    return F.when(static, F.lit(0.0)).otherwise(w1 * direction + w2 * speed)


def movement_velocity(movements: Column, edge: str) -> list[Column]:
    """Velocity vector of the first (``entry``) or last (``exit``) movement, zeros without one."""
    m = F.try_element_at(movements, F.lit(1 if edge == "entry" else -1))
    return [F.coalesce(m[f"{c}_{edge}_vel"], F.lit(0.0)) for c in ("pan", "tilt", "zoom")]


def segment_penalty(movements: Column, w3: float = EDITOR.w3, w4: float = EDITOR.w4) -> Column:
    """Instability minus steadiness of the first movement; 0 without movements."""
    m = F.try_element_at(movements, F.lit(1))
    return penalty_from_stats(
        [F.coalesce(m[f"{c}_std_deriv"], F.lit(0.0)) for c in ("pan", "tilt", "zoom")],
        [F.coalesce(m[f"{c}_monotonicity"], F.lit(0.0)) for c in ("pan", "tilt", "zoom")],
        w3, w4,
    )


def penalty_from_stats(stds: Sequence[Column], monotonicities: Sequence[Column],
                       w3: float = EDITOR.w3, w4: float = EDITOR.w4) -> Column:
    instability = reduce(lambda a, b: a + b, stds) / 3.0
    steadiness = reduce(lambda a, b: a + b, [F.abs(m) for m in monotonicities]) / 3.0
    return w3 * instability - w4 * steadiness


def quality_multiplier(rating: Column) -> Column:
    """Multiplier of a rating, case-insensitive; missing or unknown ratings count 1."""
    table = F.create_map(*[F.lit(x) for kv in QUALITY_MULTIPLIERS.items() for x in kv])
    return F.coalesce(F.try_element_at(table, F.lower(rating)), F.lit(1.0))


def total_cost(kinematic: Column, penalty: Column, narrative: Column, rating: Column,
               w5: float = EDITOR.w5) -> Column:
    return weighted_cost(kinematic, penalty, narrative, quality_multiplier(rating), w5)


def weighted_cost(kinematic: Column, penalty: Column, narrative: Column, multiplier: Column, w5: float = EDITOR.w5) -> Column:
    return multiplier * (kinematic + penalty + w5 * (1.0 - narrative))


def magnitude_penalty(a: Sequence[Column], b: Sequence[Column]) -> Column:
    """exp(-|ln(|b|/|a|)|), null when either vector is negligible."""
    na, nb = norm(a), norm(b)
    return F.when((na >= TINY_NORM) & (nb >= TINY_NORM), F.exp(-F.abs(F.ln(nb / na))))


def velocity_cosine(a: Sequence[Column], b: Sequence[Column]) -> Column:
    scale = norm(a) * norm(b)
    return F.when(scale >= TINY_NORM, dot_columns(a, b) / scale)


# -- geometry and sampling ------------------------------------------------

def decompose_matrix(h: Column, width: Column, height: Column) -> dict[str, Column]:
    """Pan, tilt, roll and zoom of a row-major 3x3 matrix."""
    h00, h02, h10, h12 = (F.element_at(h, i) for i in (1, 3, 4, 6))
    return {
        "pan": h02 / width,
        "tilt": h12 / height,
        "roll": F.degrees(F.atan2(h10, h00)),
        "zoom": F.sqrt(h00 * h00 + h10 * h10) - 1.0,
    }


def scaled_height(width: Column, height: Column, target: Column | int) -> Column:
    """Height after scaling to ``target`` width: truncated, then made even."""
    target = target if isinstance(target, Column) else F.lit(target)
    h = F.floor(target * (height / width)).cast("int")
    return (h + h % 2).cast("int")


def sample_time(index: Column, fps: Column | float) -> Column:
    return (index + 1) / fps


def rational_time(seconds: Column, rate: float) -> Column:
    """Frame number at ``rate``, rounding halves to even."""
    return F.rint(seconds * rate).cast("long")


def pose_speed(channels: Sequence[Column]) -> Column:
    return norm(channels)


def motion_category(monotonicity: Column, cv: Column) -> Column:
    """Label from directional consistency and variability of speed."""
    # Thresholds and labels.
    steady = F.coalesce(F.abs(monotonicity) >= 0.5, F.lit(False))
    bursty = F.coalesce(cv > 1.0, F.lit(False))
    return (
        F.when(steady & ~bursty, "smooth sweep")
        .when(steady & bursty, "sweep / speed bursts")
        .when(~steady & ~bursty, "static")
        .otherwise("chaotic / handheld")
    )


# -- identity -------------------------------------------------------------

def segment_id(source: Column, index: Column) -> Column:
    return F.substring(F.sha2(F.concat_ws(":", source, index.cast("string")), 256), 1, 8)


def short_id(name: Column, start: Column | None = None) -> Column:
    """First 8 hex digits of the MD5 of a file name, optionally with a start time."""
    text = name if start is None else F.concat_ws(":", name, F.format_string("%.3f", start))
    return F.substring(F.md5(text), 1, 8)


def content_hash(content: Column, length: Column) -> Column:
    """16 hex digits of SHA-256 over the first 64 KiB and the decimal file size."""
    head = F.substring(content, 1, 64 * 1024)
    size = F.encode(length.cast("string"), "UTF-8")
    return F.substring(F.sha2(F.concat(head, size), 256), 1, 16)


# -- decisions ------------------------------------------------------------

def story_decision(context: Column, total: Column, revisions: Column,
                   settings=STORYBOARD) -> Column:
    return (
        F.when(context < settings.context_threshold, "revise")
        .when((total >= settings.review_threshold) | (revisions >= settings.max_revisions), "approve")
        .otherwise("revise")
    )


def storyboard_decision(score: Column, revisions: Column, settings=STORYBOARD) -> Column:
    return (
        F.when(score >= settings.review_threshold, "approve")
        .when(revisions >= settings.max_revisions, "escalate")
        .otherwise("revise")
    )


def review_route(structural_issues: Column, round_no: Column, max_rounds: int = 1) -> Column:
    """Where a reviewed timeline goes; a missing review approves."""
    return (
        F.when(~F.coalesce(structural_issues, F.lit(False)), "persist")
        .when(round_no >= max_rounds, "persist")
        .otherwise("reassemble")
    )


def review_score(score: Column) -> Column:
    return F.coalesce(score, F.lit(0.5))


def stitch_action(action: Column, transition_type: Column) -> Column:
    """Cut, unless the decision on the entry is a transition (dissolve by default)."""
    named = F.coalesce(F.nullif(transition_type, F.lit("")), F.lit("dissolve"))
    return F.when(action == "transition", named).otherwise("cut")


# -- processing status ----------------------------------------------------

def completed_steps(steps: dict[str, Column]) -> Column:
    """Names of the finished steps in processing order; ``steps`` maps name to completion."""
    done = F.array(*[F.when(steps[s].isNotNull(), F.lit(s)) for s in PROCESSING_STEPS])
    return F.filter(done, lambda s: s.isNotNull())


def processing_percent(done: Column) -> Column:
    return F.floor(F.size(done) * 100.0 / len(PROCESSING_STEPS) + 0.5).cast("int")


def fully_processed(done: Column) -> Column:
    return F.size(done) == len(PROCESSING_STEPS)


def current_step(done: Column) -> Column:
    return F.try_element_at(done, F.lit(-1))


def step_current(completed_at: Column, stored_hash: Column, given_hash: Column) -> Column:
    """True when the step is done and was done under the given configuration."""
    return completed_at.isNotNull() & F.coalesce(stored_hash == given_hash, F.lit(False))


# -- timeline display -----------------------------------------------------

def playhead(offset: Column, at: Column, start: Column, total: Column) -> tuple[Column, Column]:
    """Global playback second and its percentage of the whole timeline."""
    position = offset + F.greatest(at - start, F.lit(0.0))
    whole = F.when(F.coalesce(total, F.lit(0.0)) == 0.0, F.lit(1.0)).otherwise(total)
    return position, F.least(position / whole * 100.0, F.lit(100.0))


def relative_interval(outer_start: Column, outer_length: Column, start: Column, end: Column,
                      min_width: float = 1.0) -> tuple[Column, Column]:
    """Left edge and width of a child interval in percent of its parent."""
    left = (start - outer_start) / outer_length * 100.0
    width = (end - start) / outer_length * 100.0
    return F.greatest(left, F.lit(0.0)), F.greatest(width, F.lit(min_width))
