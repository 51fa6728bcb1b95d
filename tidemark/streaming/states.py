"""Streams with a small state a key: direction hysteresis, shock cooldown, ordered ingest."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

SEVERITY = {"normal": 0, "guarded": 1, "lockdown": 2}


def fold(stream: DataFrame, keys: list[str], columns: list[str], order: list[str], step: Callable, added: str, state_schema: str) -> DataFrame:
    """Fold a stream's rows by key: ``step(state or None, row)`` gives (state, values of the ``added`` columns).

    Rows of a trigger go in ``order``; rows of different triggers as these come,
    so a source must not bring a key's older rows later. Only the state outlives
    a trigger.
    """
    fields = {f.name: f.dataType.simpleString() for f in stream.schema}
    out = [*keys, *columns]
    names = out + [part.split()[0] for part in added.split(",")]

    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held, made = state.get if state.exists else None, []
        for row in pd.concat(list(parts)).sort_values(order, kind="stable")[columns].itertuples(index=False):
            held, values = step(held, row)
            made.append((*key, *row, *values))
        state.update(held)
        yield pd.DataFrame(made, columns=names)

    schema = ", ".join(f"`{c}` {fields[c]}" for c in out) + ", " + added
    return stream.select(*out).groupBy(*keys).applyInPandasWithState(run, schema, state_schema, "append", GroupStateTimeout.NoTimeout)


#: The least size of a score (and the trendiness) to enter a side, to stay on it and to turn round; in a range, what excuses an entry.
ENTER, ENTER_TREND, STAY, FLIP = 0.14, 0.28, 0.09, 0.18
FLIP_STRENGTH, FLIP_COHERENCE = 0.18, 0.58
RANGE_SCORE, RANGE_STRENGTH, RANGE_COHERENCE = 0.15, 0.14, 0.62


def _excused(row, size: float) -> bool:
    """A range may still be entered with its own bias, on strong and coherent evidence."""
    return row.regime == "range" and row.bias == row.direction and size >= RANGE_SCORE and row.strength >= RANGE_STRENGTH and row.coherence >= RANGE_COHERENCE


def hold_direction(state: tuple | None, row, gap: int) -> tuple[tuple, tuple]:
    """One step of hysteresis: leave neutral only on a clear score, turn round only on a clearer one.

    The rules, the later over the earlier: a weak score or trend is neutral; so is
    a range without a score to flip; a side held of late outlasts a fading score
    outside ranges, and any score too weak to turn it round.
    """
    size, sided, ranging = abs(row.score), row.direction in ("long", "short"), row.regime == "range"
    free = sided and _excused(row, size)
    before = state[1] if state is not None and row.ts - state[0] <= max(gap, 60) else "neutral"
    rules = [
        (sided and not free and (size < ENTER or row.trendiness < ENTER_TREND), "neutral", "enter_deadband"),
        (ranging and not free and size < FLIP, "neutral", "range_neutrality_hold" if sided else "pass_through"),
    ]
    now, mode = next(((to, why) for rule, to, why in reversed(rules) if rule), (row.direction, "pass_through"))
    turns = now not in ("neutral", before) and (size < FLIP or row.strength < FLIP_STRENGTH or row.coherence < FLIP_COHERENCE)
    if before != "neutral" and (turns or (now == "neutral" and size >= STAY and not ranging)):
        now, mode = before, "hysteresis_hold"
    return (int(row.ts), now), (now, mode)


def direction_hysteresis(stream: DataFrame, keys: list[str], gap: int = 900) -> DataFrame:
    """Stable directions: adds stable and mode. Takes ts, direction, bias, regime, score, strength, trendiness, coherence."""
    columns = ["ts", "direction", "bias", "regime", "score", "strength", "trendiness", "coherence"]
    return fold(stream, keys, columns, ["ts"], lambda s, r: hold_direction(s, r, gap), "stable string, mode string", "ts long, direction string")


def hold_severity(state: tuple | None, row, hold: int) -> tuple[tuple, tuple]:
    """One step of a release cooldown: lockdown lasts ``hold`` seconds from when it last held by itself, guarded half of that before normal."""
    if state is not None:
        since, held = state
        age = row.ts - since
        calmer = SEVERITY.get(held, 0) > SEVERITY.get(row.severity, 0) and age <= max(hold, 60)
        if calmer and (held == "lockdown" or (row.severity == "normal" and age <= max(hold // 2, 60))):
            return state, (held, True)
    return (int(row.ts), row.severity), (row.severity, False)


def release_cooldown(stream: DataFrame, keys: list[str], hold: int = 900) -> DataFrame:
    """Severities that fall only after a cooldown: adds stable and held. Takes ts and severity (normal, guarded or lockdown)."""
    return fold(stream, keys, ["ts", "severity"], ["ts"], lambda s, r: hold_severity(s, r, hold), "stable string, held boolean", "ts long, severity string")


def ordered_ingest(stream: DataFrame, keys: list[str], index: str, order: list[str]) -> DataFrame:
    """Whether each message comes after all before it of its key, by ``index``: adds accepted. Others are reported, not kept."""

    def step(state: tuple | None, row) -> tuple[tuple, tuple]:
        at = int(getattr(row, index))
        fits = state is None or at > state[0]
        return (at,) if fits else state, (fits,)

    return fold(stream, keys, list(dict.fromkeys([index, *order])), order, step, "accepted boolean", "last long")


def confirm(state: tuple | None, row, gap: int, needed: int) -> tuple[tuple | None, tuple]:
    """One step of persistence: snapshots of one side count while each is later than the last and is seen within ``gap`` of it; the same one again counts no more."""
    good = all(x is not None and x == x and x > 0 for x in (row.ts, row.evidence))
    if not good:
        return (0, 0, 0, ""), (0, False)
    seen, count, evidence, side = state or (0, 0, 0, "")
    fresh = side == row.direction and seen > 0 and row.ts - seen <= gap
    if fresh and row.evidence == evidence:
        return state, (count, count >= needed)
    count = count + 1 if fresh and row.evidence > evidence else 1
    return (int(row.ts), count, int(row.evidence), row.direction), (count, count >= needed)


def persistence_gate(stream: DataFrame, keys: list[str], gap: int, needed: int = 2) -> DataFrame:
    """Lets a direction pass once ``needed`` distinct, later snapshots agree: adds count and passed. Takes ts (when it was seen), direction and evidence (when it was made)."""
    return fold(stream, keys, ["ts", "direction", "evidence"], ["ts"], lambda s, r: confirm(s, r, gap, needed), "count long, passed boolean", "ts long, count long, evidence long, direction string")


def hold_veto(state: tuple | None, row, release: int) -> tuple[tuple, tuple]:
    """One step of a veto's release: a calm row within ``release`` seconds (60 at least) of a break still counts as that break."""
    if row.state == "normal" and state is not None and state[1] != "normal" and row.ts - state[0] <= max(release, 60):
        return state, (state[1], True)
    return (int(row.ts), row.state), (row.state, False)


def veto_cooldown(stream: DataFrame, keys: list[str], release: int = 120) -> DataFrame:
    """Breaks that last some time after the last of them: adds stable and held. Takes ts and state (normal or a break)."""
    return fold(stream, keys, ["ts", "state"], ["ts"], lambda s, r: hold_veto(s, r, release), "stable string, held boolean", "ts long, state string")


#: Rises of score, confidence and reward to risk, and shift of entry (percent), from which a publication is a material upgrade.
UPGRADE_SCORE, UPGRADE_CONFIDENCE, UPGRADE_REWARD, UPGRADE_ENTRY = 0.08, 0.05, 0.08, 1.0


def material_upgrade(before: tuple, now: tuple) -> bool:
    """Whether (score, confidence, reward to risk, entry) is materially better than, or apart from, what came before; missing values count as 0, a missing entry as the same."""
    rises = [round((b or 0.0) - (a or 0.0), 6) for a, b in zip(before[:3], now[:3], strict=True)]
    shift = abs(now[3] - before[3]) / before[3] * 100 if before[3] and before[3] > 0 and now[3] and now[3] > 0 else 0.0
    return rises[0] >= UPGRADE_SCORE or rises[1] >= UPGRADE_CONFIDENCE or rises[2] >= UPGRADE_REWARD or shift >= UPGRADE_ENTRY


def lock_publication(state: tuple | None, row, horizon: int, alive: int, cooldown: int) -> tuple[tuple, tuple]:
    """One step of the publication lock.

    The state is the position that is open (id, until when) and the publication
    that goes with it (id, when, values). While the position is open, rows reuse
    the publication as long as it is alive, and then publish a fresh one without a
    second label. After it, within the cooldown, a row is new only on a material
    upgrade. A row that publishes with a label locks for ``horizon`` seconds.
    """
    ts, rec = int(row.ts), int(row.rec)
    plain = lambda x: None if x is None or x != x else float(x)
    values = tuple(plain(x) for x in (row.score, row.confidence, row.reward, row.entry))
    fresh = ((rec, ts + horizon, rec, ts, *values), ("publish_new", rec, rec, True))
    if state is None:
        return fresh
    position, until, publication, since, *before = state
    if ts < until:
        if ts - since <= alive:
            return state, ("reuse_active", publication, position, False)
        return (position, until, rec, ts, *values), ("publish_fresh_operator_root", rec, position, False)
    if ts - since > cooldown or material_upgrade(tuple(before), values):
        return fresh
    return state, ("reuse_active", publication, position, False)


def publication_lock(stream: DataFrame, keys: list[str], horizon: int, alive: int, cooldown: int) -> DataFrame:
    """What each recommendation of a stream becomes: adds decision, publication_root, outcome_root, labels. Takes ts, rec (id, a number), score, confidence, reward, entry.

    The lock ends by the rows' own times. State steps order the rows of a trigger
    by time; triggers must come in order of time.
    """
    columns = ["ts", "rec", "score", "confidence", "reward", "entry"]
    added = "decision string, publication_root long, outcome_root long, labels boolean"
    state = "position long, until long, publication long, since long, score double, confidence double, reward double, entry double"
    return fold(stream, keys, columns, ["ts", "rec"], lambda s, r: lock_publication(s, r, horizon, alive, cooldown), added, state)


def warm_up(state: tuple | None, row, cooldown: int) -> tuple[tuple, tuple]:
    """One step of the warm-up log: an event when readiness is lost, when what is missing changes and the last event is ``cooldown`` seconds old, and when it is back."""
    blocked, signature, logged = state or (False, "", 0)
    ts, event = int(row.ts), None
    if not row.ready:
        if not blocked or (row.signature != signature and ts - logged >= max(1, cooldown)):
            event = "RECO_WARMUP_SKIP"
    elif blocked:
        event = "RECO_WARMUP_RECOVERED"
    return (not row.ready, row.signature, ts if event else logged), (event,)


def warm_up_events(stream: DataFrame, keys: list[str], cooldown: int) -> DataFrame:
    """Events of the warm-up log: adds event (null: nothing to log). Takes ts, ready and signature (of what is missing)."""
    return fold(stream, keys, ["ts", "ready", "signature"], ["ts"], lambda s, r: warm_up(s, r, cooldown), "event string", "blocked boolean, signature string, logged long")


#: Errors in ten minutes and share of symbols stale or missing from which an alert is due.
ALERT_ERRORS, ALERT_STALE = 5, 0.5


def due_alerts(health: DataFrame) -> DataFrame:
    """Alerts that are due, a row each: the columns of ``health`` and alert (collect_errors, symbols_stale, no_recos).

    ``health`` has errors, bad, total and healthy (numbers of symbols) and recommendations.
    """
    rules = {
        "collect_errors": F.col("errors") >= ALERT_ERRORS,
        "symbols_stale": (F.col("total") > 0) & (F.col("bad") / F.greatest(F.col("total"), F.lit(1)) >= ALERT_STALE),
        "no_recos": (F.col("recommendations") == 0) & (F.col("healthy") > 0),
    }
    found = F.filter(F.array(*[F.when(rule, F.lit(name)) for name, rule in rules.items()]), lambda a: a.isNotNull())
    return health.withColumn("alert", F.explode(found))


def alert_cooldown(stream: DataFrame, keys: list[str], cooldown: int) -> DataFrame:
    """Which due alerts are sent: adds sent; after one, ``cooldown`` seconds pass before the next of its keys. Takes ts."""

    def step(state: tuple | None, row) -> tuple[tuple, tuple]:
        sends = state is None or row.ts - state[0] >= cooldown
        return ((int(row.ts),) if sends else state), (sends,)

    return fold(stream, keys, ["ts"], ["ts"], step, "sent boolean", "last long")
