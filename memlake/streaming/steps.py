"""The state machines as pure functions: (state, row) -> new state and what is emitted.

Batch replay and streaming share them.  A state is a plain dict; a row is a mapping.
"""

from __future__ import annotations

PRESENCE_COOLDOWN, RULE_GAP, VERIFY_RETRY, SETTLE_FRAMES, TRIGGER_COOLDOWN = 10.0, 5.0, 30.0, 3, 30.0


def presence(state: dict, ts: float, cooldown: float = PRESENCE_COOLDOWN) -> bool:
    """Whether a sighting is written: not within the cooldown of the last one written.

    A late row lies before the last one and is suppressed with the rest.
    """
    last = state.get("last")
    if last is not None and ts - last < cooldown:
        return False
    state["last"] = ts
    return True


def rule(state: dict, ts: float, matches: bool, in_zone: bool, dwell: float, cooldown: float, verify=None) -> bool:
    """Whether a rule fires for a subject's sighting.

    ``matches``: class and camera fit; otherwise nothing changes.  Outside the zone the
    dwell clock is lost.  A subject unseen for longer than the gap starts anew.
    ``verify`` is None for rules without a check, else a callable giving the verdict; a
    check is asked again no sooner than the retry time.
    """
    if not matches:
        return False
    if not in_zone:
        state.pop("first", None)
        return False
    seen = state.get("seen")
    if seen is not None and ts - seen > RULE_GAP:
        state.pop("first", None)
    state["seen"] = ts
    first = state.setdefault("first", ts)
    if ts - first < dwell:
        return False
    fired = state.get("fired")
    if fired is not None and ts - fired < cooldown:
        return False
    if verify is not None:
        asked = state.get("asked")
        if asked is not None and ts - asked < VERIFY_RETRY:
            return False
        state["asked"] = ts
        if verify() != "yes":
            return False
    state["fired"] = ts
    return True


def settle(state: dict, moving: bool, frames: int = SETTLE_FRAMES) -> bool:
    """True on the frame at which a scene that moved has been still for so many frames."""
    if moving:
        state["streak"], state["moved"] = 0, True
        return False
    state["streak"] = state.get("streak", 0) + 1
    if state.get("moved") and state["streak"] >= frames:
        state["moved"] = False
        return True
    return False


def trigger(state: dict, ts: float, changed: bool, signature: str, moving: bool, settled: bool, lazy: bool = True, cooldown: float = TRIGGER_COOLDOWN) -> bool:
    """Whether a scene is described now.

    A change is remembered until a description is made; a lazy trigger waits for a still
    picture; the same scene isn't described twice within the cooldown.
    """
    state["pending"] = state.get("pending", False) or changed
    if not state["pending"] or (lazy and moving and not settled):
        return False
    calls = state.setdefault("calls", {})
    last = calls.get(signature)
    if last is not None and ts - last < cooldown:
        return False
    for known in [k for k, v in calls.items() if ts - v >= cooldown]:
        del calls[known]  # past its cooldown it no longer matters
    calls[signature] = ts
    state["pending"] = False
    return True
