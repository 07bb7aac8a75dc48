-- User-journey report, Spark SQL. Bind {events} to the event DataFrame and
-- :as_of to the evaluation time. Returns the same rows as
-- milepost.plans.journey.user_journey (checked by the tests), with the same
-- two scans: all events hash-aggregated per (user, block of 64 UTC days, city)
-- with the active days as bitmaps, merged per user; and the events of four
-- families ranked per (user, family) for the n-th ones.
WITH base AS (
  SELECT
    user_pseudo_id, geo.city AS city, event_name,
    timestamp_micros(event_timestamp) AS ts,
    unix_date(to_date(timestamp_micros(event_timestamp))) AS day,
    CASE WHEN event_name = 'screen_view'
         THEN size(filter(event_params, p -> p.key = 'firebase_screen' AND p.value.string_value IS NOT NULL))
         ELSE 0 END AS np,
    (event_name IN ('first_open', 'onboarding_step1_registration_complete', 'onboarding_step7_carplay_complete')
     OR event_name LIKE 'integration_created_%') AS in_cohort
  FROM {events}
),
facts AS (
  SELECT
    user_pseudo_id, shiftright(day, 6) AS block, city,
    bool_or(in_cohort) AS in_cohort,
    min(CASE WHEN in_cohort AND event_name = 'first_open' THEN ts END) AS s1,
    min(CASE WHEN in_cohort AND event_name = 'onboarding_step1_registration_complete' THEN ts END) AS s2,
    min(CASE WHEN in_cohort AND event_name = 'onboarding_step7_location_complete' THEN ts END) AS s3,
    min(CASE WHEN in_cohort AND event_name LIKE 'integration_created_%' THEN ts END) AS s4,
    max(CASE WHEN np > 0 THEN ts END) AS last_screen,
    sum(np) AS screen_rows,
    sum(CASE WHEN ts >= :as_of - INTERVAL 24 HOURS THEN np END) AS sv24,
    sum(CASE WHEN ts >= :as_of - INTERVAL 48 HOURS THEN np END) AS sv48,
    sum(CASE WHEN ts >= :as_of - INTERVAL 72 HOURS THEN np END) AS sv72,
    bit_or(CASE WHEN event_name IS NOT NULL THEN shiftleft(1L, day & 63) END) AS bits,
    count_if(event_name = 'user_facing_error') AS errors
  FROM base
  GROUP BY user_pseudo_id, shiftright(day, 6), city
),
blocks AS (
  SELECT
    user_pseudo_id, block,
    bool_or(in_cohort) AS in_cohort,
    min(s1) AS s1, min(s2) AS s2, min(s3) AS s3, min(s4) AS s4,
    max(last_screen) AS last_screen, sum(screen_rows) AS screen_rows,
    sum(sv24) AS sv24, sum(sv48) AS sv48, sum(sv72) AS sv72,
    bit_or(bits) AS bits, sum(errors) AS errors, min(city) AS city
  FROM (SELECT /*+ REPARTITION(user_pseudo_id) */ * FROM facts)
  GROUP BY user_pseudo_id, block
),
per_user AS (
  SELECT
    user_pseudo_id,
    min(s1) AS s1, min(s2) AS s2, min(s3) AS s3, min(s4) AS s4,
    max(last_screen) AS last_screen, sum(screen_rows) AS screen_rows,
    sum(sv24) AS sv24, sum(sv48) AS sv48, sum(sv72) AS sv72,
    sum(coalesce(bit_count(bits), 0)) AS active_days,
    sum(coalesce(bit_count(CASE
      WHEN block > shiftright(cutoff, 6) THEN bits
      WHEN block = shiftright(cutoff, 6) THEN bits & shiftleft(-1L, cutoff & 63) END), 0)) AS recent_days,
    sum(errors) AS errors, min(city) AS city
  FROM (SELECT *, unix_date(date_sub(to_date(:as_of), 30)) AS cutoff FROM blocks)
  GROUP BY user_pseudo_id
  HAVING bool_or(in_cohort)
),
ranked AS (
  SELECT user_pseudo_id, user_id, timestamp_micros(event_timestamp) AS ts, family,
         row_number() OVER (PARTITION BY user_pseudo_id, family ORDER BY event_timestamp, event_id) AS rn
  FROM (
    SELECT user_pseudo_id, event_timestamp, event_id,
      CASE WHEN event_name = 'onboarding_step3_phone_verified_complete' THEN user_id END AS user_id,
      CASE
        WHEN event_name IN ('receive_statement_flags', 'receive_yesno_flags', 'receive_multichoice_flags',
                            'receive_location_share_flags', 'receive_location_request_flags',
                            'receive_eta_share_flags', 'receive_eta_request_flags',
                            'receive_status_share_flags', 'receive_status_request_flags',
                            'open_statement_flags', 'open_yesno_flags', 'open_multichoice_flags',
                            'open_location_share_flags', 'open_location_request_flags',
                            'open_eta_share_flags', 'open_eta_request_flags',
                            'open_status_share_flags', 'open_status_request_flags')
          OR event_name LIKE 'receive_3p_message_%' OR event_name LIKE 'receive_email_%'
          OR event_name LIKE 'open_3p_message_%' OR event_name LIKE 'open_email_%' THEN 'message'
        WHEN event_name IN ('create_statement_flags', 'create_yesno_flags', 'create_multichoice_flags',
                            'create_location_share_flags', 'create_location_request_flags',
                            'create_eta_share_flags', 'create_eta_request_flags',
                            'create_status_share_flags', 'create_status_request_flags',
                            'respond_statement_flags', 'respond_yesno_flags', 'respond_multichoice_flags',
                            'respond_location_share_flags', 'respond_location_request_flags',
                            'respond_eta_share_flags', 'respond_eta_request_flags',
                            'respond_status_share_flags', 'respond_status_request_flags')
          OR event_name LIKE 'create_3p_message_%' OR event_name LIKE 'create_email_%'
          OR event_name LIKE 'respond_3p_message_%' OR event_name LIKE 'respond_email_%' THEN 'interaction'
        WHEN event_name IN ('integration_created_gmailemail', 'integration_created_outlookemail',
                            'integration_created_slack', 'integration_created_msteams',
                            'integration_created_googlecalendar',
                            'integration_created_outlookcalendar') THEN 'named_integration'
        WHEN event_name = 'onboarding_step3_phone_verified_complete' THEN 'verified'
      END AS family
    FROM {events}
    -- a superset of the families that Parquet can test
    WHERE event_name LIKE 'receive%' OR event_name LIKE 'open%' OR event_name LIKE 'create%'
       OR event_name LIKE 'respond%' OR event_name LIKE 'integration%' OR event_name LIKE 'onboarding%'
  )
  WHERE family IS NOT NULL
),
nth AS (
  SELECT user_pseudo_id,
    max(CASE WHEN family = 'named_integration' AND rn = 3 THEN ts END) AS s5,
    max(CASE WHEN family = 'message' AND rn = 1 THEN ts END) AS s6,
    max(CASE WHEN family = 'interaction' AND rn = 1 THEN ts END) AS s7,
    max(CASE WHEN family = 'message' AND rn = 10 THEN ts END) AS s8,
    max(CASE WHEN family = 'interaction' AND rn = 5 THEN ts END) AS s9,
    max(CASE WHEN family = 'verified' AND rn = 1 THEN user_id END) AS user_id
  FROM ranked
  WHERE rn <= 10
  GROUP BY user_pseudo_id
)
SELECT
  u.user_pseudo_id,
  CASE WHEN u.user_pseudo_id IS NOT NULL THEN n.user_id END AS user_id,
  date_format(from_utc_timestamp(u.s1, 'CET'), 'yyyy-MM-dd HH:mm:ss') AS step1_first_open,
  CASE WHEN u.user_pseudo_id IS NOT NULL THEN u.city END AS location,
  CASE WHEN u.user_pseudo_id IS NOT NULL AND u.screen_rows > 0
       THEN date_format(from_utc_timestamp(u.last_screen, 'CET'), 'yyyy-MM-dd HH:mm:ss') END AS last_screen_view,
  CASE WHEN u.user_pseudo_id IS NOT NULL AND u.screen_rows > 0 THEN CAST(coalesce(u.sv24, 0) AS BIGINT) END AS screen_views_last_24h,
  CASE WHEN u.user_pseudo_id IS NOT NULL AND u.screen_rows > 0 THEN CAST(coalesce(u.sv48, 0) AS BIGINT) END AS screen_views_last_48h,
  CASE WHEN u.user_pseudo_id IS NOT NULL AND u.screen_rows > 0 THEN CAST(coalesce(u.sv72, 0) AS BIGINT) END AS screen_views_last_72h,
  date_format(from_utc_timestamp(u.s2, 'CET'), 'yyyy-MM-dd HH:mm:ss') AS step2_registers_account,
  date_format(from_utc_timestamp(u.s3, 'CET'), 'yyyy-MM-dd HH:mm:ss') AS step3_provides_permission,
  date_format(from_utc_timestamp(u.s4, 'CET'), 'yyyy-MM-dd HH:mm:ss') AS step4_connects_1_integration,
  date_format(from_utc_timestamp(n.s5, 'CET'), 'yyyy-MM-dd HH:mm:ss') AS step5_connects_3_integrations,
  CASE WHEN u.user_pseudo_id IS NOT NULL
       THEN date_format(from_utc_timestamp(n.s6, 'CET'), 'yyyy-MM-dd HH:mm:ss') END AS step6_receives_and_opens_1st_message_or_email,
  CASE WHEN u.user_pseudo_id IS NOT NULL
       THEN date_format(from_utc_timestamp(n.s7, 'CET'), 'yyyy-MM-dd HH:mm:ss') END AS step7_sends_1st_email_or_message_or_status_share,
  date_format(from_utc_timestamp(n.s8, 'CET'), 'yyyy-MM-dd HH:mm:ss') AS step8_receives_and_opens_10th_msg_or_email,
  date_format(from_utc_timestamp(n.s9, 'CET'), 'yyyy-MM-dd HH:mm:ss') AS step9_sends_5th_email_message_status_share,
  u.user_pseudo_id IS NOT NULL AND u.active_days >= 2 AS step14_is_active_on_day_2,
  u.user_pseudo_id IS NOT NULL AND u.active_days >= 5 AS step15_is_active_on_day_5,
  u.user_pseudo_id IS NOT NULL AND u.active_days >= 10 AS step16_is_active_on_day_10,
  CAST(CASE WHEN u.user_pseudo_id IS NOT NULL THEN u.recent_days ELSE 0 END AS BIGINT) AS step17_days_active_in_last_30_days,
  CAST(CASE WHEN u.user_pseudo_id IS NOT NULL THEN u.errors ELSE 0 END AS BIGINT) AS user_error_count
FROM per_user u
LEFT JOIN nth n ON u.user_pseudo_id = n.user_pseudo_id
