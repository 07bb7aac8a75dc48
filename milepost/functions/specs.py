"""Milestone specifications: which event, picked how, printed as which column.

Milestones are data. The journey report and the new-user report are two
spec lists over the same builders in :mod:`milepost.operators.milestones`.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from milepost.functions import families as fam


@dataclass(frozen=True)
class Milestone:
    """One output column: the time of an event that matches ``event`` /
    ``like`` (and, for screen milestones, a screen parameter value)."""

    column: str
    event: str | None = None
    like: str | None = None
    screen_value: str | None = None  # compared case-insensitively

    def predicate(self, name: Column, params: Column | None = None) -> Column:
        if self.like is not None:
            cond = name.like(self.like)
        else:
            cond = name == F.lit(self.event)
        if self.screen_value is not None:
            if params is None:
                raise ValueError(f"{self.column} needs event_params")
            keys = F.array(*[F.lit(k) for k in fam.SCREEN_PARAM_KEYS])
            value = self.screen_value
            cond = cond & F.exists(
                params,
                lambda p: F.array_contains(keys, p["key"])
                & (F.lower(p["value"]["string_value"]) == F.lit(value)),
            )
        return cond


# ---------------------------------------------------------------------------
# Output column names and the events behind them.
# ---------------------------------------------------------------------------

# Journey report, first time of each onboarding step (evaluated inside the
# report's cohort filter, so step3 stays NULL as in the source report).
JOURNEY_FIRST = [
    Milestone("step1_first_open", event="first_open"),
    Milestone("step2_registers_account", event="onboarding_step1_registration_complete"),
    Milestone("step3_provides_permission", event="onboarding_step7_location_complete"),
    Milestone("step4_connects_1_integration", like="integration_created_%"),
]

# New-user report, latest time of each step.
NEW_USER_LATEST = [
    Milestone("First_Open", event="first_open"),
    Milestone("Welcome_Screen", event="screen_view", screen_value="welcomescreen"),
    Milestone("Registration_Info_Completed", event="onboarding_step1_registration_complete"),
    Milestone("Error_Encountered", event="onboarding_step2_otp_error_or_invalid"),
    Milestone("User_Registered", event="onboarding_step3_phone_verified_start"),
    Milestone("Permission_Push_Notification", event="onboarding_step4_notifications_granted"),
    Milestone("Permission_Contacts", event="onboarding_step5_contacts_granted"),
    Milestone("Permission_Microphone", event="onboarding_step6_microphone_granted"),
    Milestone("Permission_Location", event="onboarding_step7_location_granted"),
    Milestone("Promotion_Offered_Early_Bird", event="paywall_shown_earlybird"),
    Milestone("Promotion_Tapped_Early_Bird", event="purchase_started_earlybird"),
    Milestone("Promotion_Subscribed_Early_Bird", event="paywall_subscribed_earlybird"),
    Milestone("Promotion_Declined_Early_Bird", event="paywall_closed_earlybird"),
    Milestone("Onboarding_Complete", event="onboarding_step9_all_done_complete"),
    Milestone("Integration_Page_Viewed", event="screen_view", screen_value="integrationslistscreen"),
    Milestone("Subscription_Wall_MS_Teams", event="subscription_wall_triggered_ms_teams"),
    Milestone("Subscription_Wall_MS_Outlook_Email", event="subscription_wall_triggered_ms_outlook_email"),
    Milestone("Subscription_Wall_MS_Outlook_Calendar", event="subscription_wall_triggered_ms_outlook_calendar"),
    Milestone("Subscription_Wall_Slack", event="subscription_wall_triggered_slack"),
    Milestone("Benefit_Explainer_Viewed", event="paywall_shown_upgrade"),
    Milestone("Trial_Started", event="paywall_subscribed_upgrade"),
    Milestone("Integration_MS_Team", event="integration_created_msteams"),
    Milestone("Integration_MS_Outlook_Email", event="integration_created_outlookemail"),
    Milestone("Integration_MS_Outlook_Calendar", event="integration_created_outlookcalendar"),
    Milestone("Integration_Slack", event="integration_created_slack"),
    Milestone("Integration_Gmail", event="integration_created_gmailemail"),
    Milestone("Integration_Google_Calendar", event="integration_created_googlecalendar"),
]

SCREEN_LATEST = [m for m in NEW_USER_LATEST if m.screen_value is not None]

# Journey report output, in order.
JOURNEY_COLUMNS = [
    "user_pseudo_id",
    "user_id",
    "step1_first_open",
    "location",
    "last_screen_view",
    "screen_views_last_24h",
    "screen_views_last_48h",
    "screen_views_last_72h",
    "step2_registers_account",
    "step3_provides_permission",
    "step4_connects_1_integration",
    "step5_connects_3_integrations",
    "step6_receives_and_opens_1st_message_or_email",
    "step7_sends_1st_email_or_message_or_status_share",
    "step8_receives_and_opens_10th_msg_or_email",
    "step9_sends_5th_email_message_status_share",
    "step14_is_active_on_day_2",
    "step15_is_active_on_day_5",
    "step16_is_active_on_day_10",
    "step17_days_active_in_last_30_days",
    "user_error_count",
]

# Journey report n-th events: (family, n, output column).
JOURNEY_NTH = [
    (fam.NAMED_INTEGRATION, 3, "step5_connects_3_integrations"),
    (fam.MESSAGES, 10, "step8_receives_and_opens_10th_msg_or_email"),
    (fam.INTERACTIONS, 5, "step9_sends_5th_email_message_status_share"),
]
JOURNEY_FIRST_OF = [
    (fam.MESSAGES, "step6_receives_and_opens_1st_message_or_email"),
    (fam.INTERACTIONS, "step7_sends_1st_email_or_message_or_status_share"),
]
JOURNEY_THRESHOLDS = [
    (2, "step14_is_active_on_day_2"),
    (5, "step15_is_active_on_day_5"),
    (10, "step16_is_active_on_day_10"),
]
JOURNEY_RECENT_DAYS = 30
SCREEN_HOURS = (24, 48, 72)
