"""Event-name families and predicates, declared once as data.

The source reports repeat each long OR-chain twice (first and n-th
event); here every family is one ``EventFamily`` and every predicate is
built from it. ``_`` in a LIKE pattern is a one-character wildcard, as in
the source SQL, and is kept that way.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# Event names and LIKE patterns matched by the source reports.
# ---------------------------------------------------------------------------
NAMED_INTEGRATIONS = [
    "integration_created_gmailemail",
    "integration_created_outlookemail",
    "integration_created_slack",
    "integration_created_msteams",
    "integration_created_googlecalendar",
    "integration_created_outlookcalendar",
]

MESSAGE_LIKES = [
    "receive_3p_message_%",
    "receive_email_%",
    "open_3p_message_%",
    "open_email_%",
]
MESSAGE_NAMES = [
    "receive_statement_flags",
    "receive_yesno_flags",
    "receive_multichoice_flags",
    "receive_location_share_flags",
    "receive_location_request_flags",
    "receive_eta_share_flags",
    "receive_eta_request_flags",
    "receive_status_share_flags",
    "receive_status_request_flags",
    "open_statement_flags",
    "open_yesno_flags",
    "open_multichoice_flags",
    "open_location_share_flags",
    "open_location_request_flags",
    "open_eta_share_flags",
    "open_eta_request_flags",
    "open_status_share_flags",
    "open_status_request_flags",
]

INTERACTION_LIKES = [
    "create_3p_message_%",
    "create_email_%",
    "respond_3p_message_%",
    "respond_email_%",
]
INTERACTION_NAMES = [
    "create_statement_flags",
    "create_yesno_flags",
    "create_multichoice_flags",
    "create_location_share_flags",
    "create_location_request_flags",
    "create_eta_share_flags",
    "create_eta_request_flags",
    "create_status_share_flags",
    "create_status_request_flags",
    "respond_statement_flags",
    "respond_yesno_flags",
    "respond_multichoice_flags",
    "respond_location_share_flags",
    "respond_location_request_flags",
    "respond_eta_share_flags",
    "respond_eta_request_flags",
    "respond_status_share_flags",
    "respond_status_request_flags",
]

ANY_INTEGRATION_LIKE = "integration_created_%"

# Cohort of the journey report: users with one of these events.
COHORT_NAMES = [
    "first_open",
    "onboarding_step1_registration_complete",
    "onboarding_step7_carplay_complete",
]

FIRST_OPEN = "first_open"
REGISTRATION = "onboarding_step1_registration_complete"
LOCATION_PERMISSION = "onboarding_step7_location_complete"
PHONE_VERIFIED = "onboarding_step3_phone_verified_complete"
SCREEN_VIEW = "screen_view"
USER_FACING_ERROR = "user_facing_error"
SCREEN_PARAM = "firebase_screen"
SCREEN_PARAM_KEYS = ["firebase_screen", "firebase_screen_class"]


def _literal_prefix(pattern: str) -> str:
    """Characters before the first LIKE wildcard ('_' or '%')."""
    out = []
    for ch in pattern:
        if ch in "_%":
            break
        out.append(ch)
    return "".join(out)


@dataclass(frozen=True)
class EventFamily:
    """A set of event names: exact names plus LIKE patterns."""

    name: str
    names: tuple = ()
    likes: tuple = ()
    extra: dict = field(default_factory=dict, hash=False, compare=False)

    def predicate(self, col: Column | str = "event_name") -> Column:
        """The family test. Given a column name the predicate is built from
        its SQL text in one call (parsed in the JVM), which is much cheaper
        than assembling dozens of literals through py4j."""
        if isinstance(col, str):
            return F.expr(self.sql(col))
        parts = []
        if self.names:
            parts.append(col.isin(list(self.names)))
        parts.extend(col.like(p) for p in self.likes)
        if not parts:
            return F.lit(False)
        return reduce(lambda a, b: a | b, parts)

    def prefixes(self) -> list[str]:
        """Literal prefixes that every matching name starts with: the text
        before the first wildcard of each pattern, and the text before the
        first '_' of each exact name (kept short so the list stays small)."""
        found = {_literal_prefix(p) for p in self.likes} | {n.split("_", 1)[0] for n in self.names}
        # drop prefixes implied by a shorter one
        return sorted(p for p in found if not any(q != p and p.startswith(q) for q in found))

    def prefilter(self, col: Column | str = "event_name") -> Column:
        """A superset test that Parquet can evaluate (STARTS WITH).

        ``LIKE 'receive_3p_message_%'`` pushes only IS NOT NULL because of
        the wildcard; ``startswith('receive')`` pushes as StringStartsWith.
        It shares no term with :meth:`predicate`, so Catalyst cannot factor
        it into an OR that Parquet could not evaluate. Used next to the
        predicate, never instead of it.
        """
        col = F.col(col) if isinstance(col, str) else col
        prefixes = self.prefixes()
        if not prefixes or "" in prefixes:
            return col.isNotNull()
        return reduce(lambda a, b: a | b, [col.startswith(p) for p in prefixes])

    def sql(self, col: str = "event_name") -> str:
        """The same predicate as SQL text (for the SQL-text report)."""
        parts = []
        if self.names:
            parts.append(f"{col} IN (" + ", ".join(f"'{n}'" for n in self.names) + ")")
        parts.extend(f"{col} LIKE '{p}'" for p in self.likes)
        return "(" + " OR ".join(parts) + ")" if parts else "FALSE"


def disjoint(families) -> bool:
    """True when no event name can belong to two of the families: every
    member of a family starts with one of its prefixes, so families whose
    prefixes never extend one another cannot share a name."""
    seen = []
    for f in families:
        pref = f.prefixes()
        if not pref or "" in pref:
            return False
        for other in seen:
            if any(a.startswith(b) or b.startswith(a) for a in pref for b in other):
                return False
        seen.append(pref)
    return True


MESSAGES = EventFamily("message", tuple(MESSAGE_NAMES), tuple(MESSAGE_LIKES))
INTERACTIONS = EventFamily("interaction", tuple(INTERACTION_NAMES), tuple(INTERACTION_LIKES))
NAMED_INTEGRATION = EventFamily("named_integration", tuple(NAMED_INTEGRATIONS))
ANY_INTEGRATION = EventFamily("any_integration", (), (ANY_INTEGRATION_LIKE,))
VERIFIED = EventFamily("verified", (PHONE_VERIFIED,))
COHORT = EventFamily("cohort", tuple(COHORT_NAMES), (ANY_INTEGRATION_LIKE,))

FAMILIES = [NAMED_INTEGRATION, ANY_INTEGRATION, MESSAGES, INTERACTIONS]
