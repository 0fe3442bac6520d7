"""DuckDB forms of the registered queries, for the correctness check."""

from __future__ import annotations

from pastlane.functions.spatial import parse_polygon
from pastlane.sources.tables import REGION

_READINGS = """readings AS (
  SELECT event_id, user_id AS link_id, value AS speed,
         TRY_CAST(json_extract_string(props, '$.k') AS INTEGER) AS volume, ts, event_type
  FROM events)"""

_LINKS = """links AS (
  SELECT vec_id AS link_id, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y
  FROM embeddings)"""

_EDGES = "edges(x1, y1, x2, y2) AS (VALUES {})".format(
    ", ".join(
        f"({ax}::DOUBLE, {ay}::DOUBLE, {bx}::DOUBLE, {by}::DOUBLE)"
        for ring in parse_polygon(REGION)
        for (ax, ay), (bx, by) in zip(ring, ring[1:])
    )
)

# Inside: an odd number of edges crossed, and on none of them.
_REGION = f"""{_LINKS}, {_EDGES},
region AS (
  SELECT link_id, x, y FROM links, edges
  GROUP BY link_id, x, y
  HAVING count(*) FILTER (WHERE (y1 > y) <> (y2 > y)
                            AND x < (x2 - x1) / (y2 - y1) * (y - y1) + x1) % 2 = 1
     AND count(*) FILTER (WHERE (x - x1) * (y2 - y1) - (y - y1) * (x2 - x1) = 0
                            AND x BETWEEN least(x1, x2) AND greatest(x1, x2)
                            AND y BETWEEN least(y1, y2) AND greatest(y1, y2)) = 0)"""

_SPLIT = """archive AS (
  SELECT * FROM readings
  WHERE ts >= TIMESTAMP '2024-01-24' AND ts < TIMESTAMP '2024-01-30'),
live AS (SELECT * FROM readings WHERE ts >= TIMESTAMP '2024-01-30')"""

_MORNING = """hour(ts) = 8 AND ts >= TIMESTAMP '2024-01-24' AND ts < TIMESTAMP '2024-01-30'"""

_FINE = "time_bucket(INTERVAL 5 MINUTE, ts)"


def _profile(source: str) -> str:
    return f"""profile AS (
  SELECT link_id, CAST(hour(ts) AS INTEGER) AS hrs, CAST(0 AS INTEGER) AS mins,
         avg(speed) AS avg_speed, avg(volume) AS avg_volume
  FROM {source} GROUP BY 1, 2)"""


_INSIDE = """archive_in AS (SELECT a.* FROM archive a JOIN region USING (link_id)),
live_in AS (SELECT l.* FROM live l JOIN region USING (link_id))"""

_JOINED = f"""{_READINGS}, {_SPLIT}, {_REGION}, {_INSIDE}, {_profile('archive_in')},
joined AS (
  SELECT l.event_id, l.link_id, l.speed, l.volume, p.link_id AS hist_link_id,
         p.avg_speed, p.avg_volume, l.ts
  FROM live_in l JOIN profile p ON p.link_id = l.link_id AND p.hrs = hour(l.ts))"""

_ROW = """link_id, speed, volume, hist_link_id, round(avg_speed, 9) AS avg_speed,
       round(avg_volume, 9) AS avg_volume, ts"""

_AVERAGES = "round(avg(speed), 9) AS avg_speed, round(avg(volume), 9) AS avg_volume"

_FLAGSHIP = f"WITH {_JOINED} SELECT {_ROW} FROM joined"

_LOOKUP = f"""WITH {_READINGS}, {_SPLIT},
history AS (
  SELECT link_id, avg(speed) AS hist_avg FROM archive
  WHERE date_trunc('hour', ts) IN (TIMESTAMP '2024-01-24 08:00:00', TIMESTAMP '2024-01-25 08:00:00')
  GROUP BY 1)
SELECT l.link_id, h.link_id AS hist_link, l.speed, round(h.hist_avg, 9) AS hist_avg, l.ts
FROM live l LEFT JOIN history h ON h.link_id = l.link_id"""

_LATEST = f"""WITH {_READINGS}
SELECT link_id, CAST(hour(ts) AS INTEGER) AS hrs, CAST(0 AS INTEGER) AS mins,
       max(event_id) AS event_id, arg_max(speed, event_id) AS speed,
       arg_max(volume, event_id) AS volume, arg_max(ts, event_id) AS ts
FROM readings GROUP BY 1, 2"""

_BATCHES = f"""WITH {_READINGS},
placed AS (
  SELECT *, row_number() OVER (PARTITION BY link_id, hour(ts) ORDER BY ts, event_id) - 1 AS position
  FROM readings)
SELECT link_id, CAST(hour(ts) AS INTEGER) AS hrs, CAST(0 AS INTEGER) AS mins,
       min(ts) AS first_ts, count(*) AS count_rec,
       round(avg(volume), 9) AS avg_volume, round(avg(speed), 9) AS avg_speed
FROM placed GROUP BY link_id, hour(ts), position // 6"""

# A batch ends with six rows, or when the next row of its group is five days after its first.
_TIME_BATCHES = f"""WITH RECURSIVE {_READINGS},
placed AS (
  SELECT *, hour(ts) AS h, row_number() OVER (PARTITION BY link_id, hour(ts) ORDER BY ts, event_id) AS place
  FROM readings),
walk AS (
  SELECT link_id, h, place, ts AS first_ts, 1 AS n, 0 AS batch FROM placed WHERE place = 1
  UNION ALL
  SELECT p.link_id, p.h, p.place,
         CASE WHEN w.n = 6 OR p.ts >= w.first_ts + INTERVAL 5 DAY THEN p.ts ELSE w.first_ts END,
         CASE WHEN w.n = 6 OR p.ts >= w.first_ts + INTERVAL 5 DAY THEN 1 ELSE w.n + 1 END,
         CASE WHEN w.n = 6 OR p.ts >= w.first_ts + INTERVAL 5 DAY THEN w.batch + 1 ELSE w.batch END
  FROM walk w JOIN placed p ON p.link_id = w.link_id AND p.h = w.h AND p.place = w.place + 1),
batches AS (
  SELECT link_id, h, batch, min(p.ts) AS first_ts, count(*) AS count_rec,
         round(avg(volume), 9) AS avg_volume, round(avg(speed), 9) AS avg_speed
  FROM walk JOIN placed p USING (link_id, h, place) GROUP BY 1, 2, 3),
ended AS (
  SELECT *, batch < max(batch) OVER (PARTITION BY link_id, h) OR count_rec = 6 AS done FROM batches)
SELECT link_id, CAST(h AS INTEGER) AS hrs, CAST(0 AS INTEGER) AS mins, first_ts, count_rec, avg_volume, avg_speed
FROM ended WHERE done"""

# The average of each day, link and hour arrives with its last reading.
_DAILY = """daily AS (
  SELECT link_id, CAST(hour(ts) AS INTEGER) AS hrs, CAST(0 AS INTEGER) AS mins,
         CAST(date_trunc('hour', ts) AS TIMESTAMP) AS slot,
         avg(speed) AS avg_speed, avg(volume) AS avg_volume, max(event_id) AS event_id
  FROM readings GROUP BY ALL)"""

_SLOTS = f"""WITH {_READINGS}
SELECT link_id, {_FINE} AS slot, count(*) AS count_rec, round(avg(speed), 9) AS avg_speed
FROM readings GROUP BY 1, 2"""


def _filled(width: int) -> str:
    return f"""counts AS (
  SELECT time_bucket(INTERVAL {width} SECOND, ts) AS window_start, count(*) AS n
  FROM events GROUP BY 1),
grid AS (
  SELECT unnest(generate_series(min(window_start), max(window_start),
                                INTERVAL {width} SECOND)) AS window_start FROM counts),
filled AS (
  SELECT window_start, coalesce(n, 0) AS n FROM grid LEFT JOIN counts USING (window_start)),
rates AS (
  SELECT window_start, n, n / {width}.0::DOUBLE AS msgs_per_s,
         CAST({width * 1_000_000} // greatest(n, 1) AS BIGINT) AS us_per_msg FROM filled)"""


_RATE = f"WITH {_filled(30)} SELECT window_start, n, msgs_per_s, us_per_msg FROM rates"


def _unexpired(condition: str) -> str:
    return f"""WITH {_READINGS}, {_SPLIT},
profile AS (
  SELECT link_id, CAST(hour(ts) AS INTEGER) AS hrs,
         CAST(minute({_FINE}) AS INTEGER) AS mins, {_AVERAGES}
  FROM archive GROUP BY 1, 2, 3 HAVING avg(speed) IS NOT NULL AND avg(volume) IS NOT NULL),
clock AS (
  SELECT arg_max(ts, event_id) AS moment FROM live WHERE ts <= TIMESTAMP '2024-01-30 13:30:00')
SELECT profile.* FROM profile, clock WHERE {condition}"""


_FLAGS = f"""WITH {_filled(3600)},
paired AS (
  SELECT window_start, us_per_msg, lag(us_per_msg) OVER (ORDER BY window_start) AS previous
  FROM rates),
changes AS (
  SELECT *, CAST(abs(previous - us_per_msg) * 100 // previous AS BIGINT) AS percent_change
  FROM paired)
SELECT *, coalesce(percent_change > 20, false) AS changed FROM changes"""

ORACLE: dict[str, str] = {
    "archive_range_scan": f"""WITH {_READINGS}
SELECT link_id, speed, volume, ts FROM readings
WHERE ts >= TIMESTAMP '2024-01-24 08:00:00' AND ts < TIMESTAMP '2024-01-24 09:00:00'
ORDER BY link_id, ts""",
    "archive_day_aligned_scan": f"""WITH {_READINGS}
SELECT link_id, speed, volume, ts FROM readings WHERE {_MORNING}""",
    "archive_all_slots": f"""WITH {_READINGS}
SELECT link_id, CAST(hour(ts) AS INTEGER) AS hrs, CAST(0 AS INTEGER) AS mins, {_AVERAGES}
FROM readings GROUP BY 1, 2""",
    "link_dimension": f"WITH {_LINKS} SELECT link_id, x, y FROM links",
    "region_links": f"WITH {_REGION} SELECT link_id, x, y FROM region",
    "region_readings": f"""WITH {_READINGS}, {_REGION}
SELECT event_id, link_id, speed, volume, ts, x, y FROM readings JOIN region USING (link_id)""",
    "parity_live": f"""WITH {_READINGS}
SELECT event_id, link_id, speed, volume, ts FROM readings WHERE link_id % 2 = minute(ts) % 2""",
    "parity_archive": f"""WITH {_READINGS}
SELECT event_id, link_id, speed, volume, ts, {_FINE} AS slot FROM readings
WHERE link_id % 2 = (epoch({_FINE} - TIMESTAMP '2024-01-01') // 300) % 2""",
    "parity_filtered_join": f"""WITH {_READINGS}, {_SPLIT},
chosen_archive AS (
  SELECT * FROM archive
  WHERE link_id % 2 = (epoch(date_trunc('hour', ts) - TIMESTAMP '2024-01-01') // 3600) % 2),
chosen_live AS (
  SELECT * FROM live
  WHERE link_id % 2 = (epoch(date_trunc('hour', ts) - TIMESTAMP '2024-01-01') // 3600) % 2),
{_profile('chosen_archive')}
SELECT l.link_id, l.speed, l.volume, p.link_id AS hist_link_id,
       round(avg_speed, 9) AS avg_speed, round(avg_volume, 9) AS avg_volume, l.ts
FROM chosen_live l JOIN profile p ON p.link_id = l.link_id AND p.hrs = hour(l.ts)""",
    "day_aligned_average": f"""WITH {_READINGS}
SELECT link_id, {_AVERAGES}, CAST(8 AS INTEGER) AS hrs, CAST(0 AS INTEGER) AS mins
FROM readings WHERE {_MORNING} GROUP BY link_id ORDER BY link_id""",
    "day_aligned_average_refnum": f"""WITH {_READINGS}
SELECT link_id, CAST(CAST(round(avg(speed), 4) AS FLOAT) AS DOUBLE) AS avg_speed,
       CAST(trunc(avg(volume)) AS INTEGER) AS avg_volume,
       CAST(8 AS INTEGER) AS hrs, CAST(0 AS INTEGER) AS mins
FROM readings WHERE {_MORNING} GROUP BY link_id""",
    "slot_aggregate": f"""WITH {_READINGS}
SELECT link_id, CAST(hour(ts) AS INTEGER) AS hrs, CAST(0 AS INTEGER) AS mins,
       count(*) AS count_rec, {_AVERAGES}
FROM readings GROUP BY 1, 2""",
    "slot_aggregate_clean": f"""WITH {_READINGS}
SELECT link_id, CAST(hour(ts) AS INTEGER) AS hrs, CAST(0 AS INTEGER) AS mins,
       count(*) AS count_rec, {_AVERAGES}
FROM readings GROUP BY 1, 2 HAVING avg(speed) IS NOT NULL AND avg(volume) IS NOT NULL""",
    "day_substreams_union": f"""WITH {_READINGS}
SELECT CAST(date_diff('day', TIMESTAMP '2024-01-24', date_trunc('day', ts)) AS INTEGER) AS day_index,
       count(*) AS count_rec, {_AVERAGES}
FROM readings GROUP BY 1""",
    "slots_5min": _SLOTS,
    "live_archive_join": _FLAGSHIP,
    "live_archive_left_join": f"""WITH {_READINGS}, {_SPLIT}, {_profile('archive')}
SELECT l.link_id, l.speed, l.volume, p.link_id AS hist_link_id,
       round(avg_speed, 9) AS avg_speed, round(avg_volume, 9) AS avg_volume, l.ts
FROM live l LEFT JOIN profile p ON p.link_id = l.link_id AND p.hrs = hour(l.ts)""",
    "fetched_slot_join": f"WITH {_JOINED} SELECT {_ROW} FROM joined WHERE hour(ts) = 8 "
    "AND ts < TIMESTAMP '2024-01-31'",
    "live_history_lookup": _LOOKUP,
    "bucketed_join_counts": f"""WITH {_JOINED}
SELECT CAST(link_id % 5 AS INTEGER) AS bucket, count(*) AS n,
       round(avg(speed), 9) AS mean_speed, round(avg(avg_speed), 9) AS mean_hist_speed
FROM joined GROUP BY 1""",
    "latest_per_slot": _LATEST,
    "length_batch": f"SELECT * FROM ({_BATCHES}) WHERE count_rec = 6",
    "length_batch_partial": _BATCHES,
    "every_nth_sample": f"""WITH {_READINGS},
placed AS (
  SELECT *, CAST(link_id % 5 AS INTEGER) AS bucket,
         row_number() OVER (PARTITION BY link_id % 5 ORDER BY ts, event_id) AS ordinal
  FROM readings)
SELECT bucket, ordinal, event_id, link_id, speed, volume, ts FROM placed WHERE ordinal % 100 = 0""",
    "live_clock": f"""WITH {_READINGS}, {_SPLIT},
running AS (
  SELECT date_trunc('hour', ts) AS slot,
         arg_max(ts, event_id) OVER (ORDER BY date_trunc('hour', ts)) AS moment FROM live),
grid AS (
  SELECT unnest(generate_series(min(slot), max(slot), INTERVAL 1 HOUR)) AS slot FROM running)
SELECT g.slot, CAST(hour(any_value(moment)) AS INTEGER) AS livehours,
       CAST(minute(any_value(moment)) AS INTEGER) AS livemins
FROM grid g ASOF JOIN (SELECT DISTINCT slot, moment FROM running) r ON g.slot >= r.slot GROUP BY 1""",
    "default_mode_join": f"""WITH {_READINGS}, {_SPLIT}, {_REGION},
chosen AS (
  SELECT a.* FROM archive a JOIN region USING (link_id)
  WHERE link_id % 2 = (epoch(date_trunc('hour', ts) - TIMESTAMP '2024-01-01') // 3600) % 2),
{_profile('chosen')}
SELECT l.link_id, l.speed, l.volume, p.link_id AS hist_link_id,
       round(avg_speed, 9) AS avg_speed, round(avg_volume, 9) AS avg_volume, l.ts
FROM live l JOIN region USING (link_id) JOIN profile p ON p.link_id = l.link_id AND p.hrs = hour(l.ts)
WHERE l.link_id % 2 = minute(l.ts) % 2 AND avg_speed IS NOT NULL AND avg_volume IS NOT NULL""",
    "time_length_batch": _TIME_BATCHES,
    "time_length_batch_stream": _TIME_BATCHES,
    "unexpired_at_the_last_row": _unexpired(
        "hour(moment) * 60 + minute(moment) <= hrs * 60 + mins").replace(
        " WHERE ts <= TIMESTAMP '2024-01-30 13:30:00'", " WHERE ts < TIMESTAMP '2024-01-30 22:00:00'"),
    "unexpired_componentwise": _unexpired("minute(moment) <= mins AND hour(moment) <= hrs"),
    "unexpired_ordered": _unexpired("hour(moment) * 60 + minute(moment) <= hrs * 60 + mins"),
    "last_per_minute": f"""WITH {_READINGS}
SELECT event_type AS series, date_trunc('minute', ts) AS minute,
       arg_max(speed, event_id) AS value
FROM readings GROUP BY 1, 2""",
    "last_10_minutes": f"""WITH {_READINGS}
SELECT event_id, link_id, speed, ts FROM readings
WHERE ts > (SELECT max(ts) - INTERVAL 10 MINUTE FROM events)""",
    "ingestion_rate_30s": _RATE,
    "rate_change_flags": _FLAGS,
    "rate_change_stream": _FLAGS,
    "throughput_30s": f"""WITH {_JOINED}
SELECT time_bucket(INTERVAL 30 SECOND, ts) AS window_start, count(*) AS n,
       count(*) / 30.0::DOUBLE AS rows_per_s,
       CAST(count(*) * 1000 // 30000 AS BIGINT) AS throughput
FROM joined GROUP BY 1""",
    "latency_last_30s": f"""WITH {_JOINED},
emitted AS (
  SELECT *, date_trunc('hour', ts) + INTERVAL 1 HOUR AS emit_ts FROM joined)
SELECT date_trunc('hour', emit_ts) AS window_start,
       arg_max(epoch_us(emit_ts) - epoch_us(ts), event_id) AS latency_us
FROM emitted GROUP BY 1""",
    "time_parts": """SELECT event_id, CAST(hour(ts) AS INTEGER) AS hrs,
       CAST(minute(ts) AS INTEGER) AS mins, CAST(second(ts) AS INTEGER) AS secs FROM events""",
    "timestamp_format_roundtrip": """SELECT event_id,
       strftime(ts, '%d-%b-%Y %H:%M:%S.%g') AS event_time,
       CAST(date_trunc('millisecond', ts) AS TIMESTAMP) AS parsed FROM events""",
    "live_stream_passthrough": f"""WITH {_READINGS}, {_SPLIT}
SELECT event_id, link_id, speed, volume, ts FROM live""",
    "live_join_stream": _FLAGSHIP,
    "live_lookup_stream": _LOOKUP,
    "slots_5min_stream": _SLOTS,
    "ingestion_rate_stream": _RATE,
    "latest_per_slot_stream": _LATEST,
    "length_batch_stream": f"SELECT * FROM ({_BATCHES}) WHERE count_rec = 6",
    "profile_advance": f"""WITH {_READINGS}, {_SPLIT}
SELECT link_id, CAST(hour(ts) AS INTEGER) AS hrs, CAST(0 AS INTEGER) AS mins, count(*) AS count_rec,
       round(avg(speed), 9) AS avg_speed, round(avg(volume), 9) AS avg_volume
FROM archive GROUP BY 1, 2""",
    "routed_join": _FLAGSHIP,
    "aged_batches_stream": f"""WITH {_READINGS},
gaps AS (
  SELECT *, hour(ts) AS h, coalesce(ts - lag(ts) OVER grp >= INTERVAL 3 DAY, false) AS late
  FROM readings WINDOW grp AS (PARTITION BY link_id, hour(ts) ORDER BY ts, event_id)),
runs AS (
  SELECT *, sum(late::INT) OVER (PARTITION BY link_id, h ORDER BY ts, event_id) AS run FROM gaps),
placed AS (
  SELECT *, (row_number() OVER (PARTITION BY link_id, h, run ORDER BY ts, event_id) - 1) // 6 AS batch FROM runs),
batches AS (
  SELECT link_id, h, run, batch, min(ts) AS first_ts, max(ts) AS last_ts, count(*) AS count_rec,
         round(avg(volume), 9) AS avg_volume, round(avg(speed), 9) AS avg_speed
  FROM placed GROUP BY 1, 2, 3, 4),
ended AS (
  SELECT *, count_rec = 6 OR run < max(run) OVER (PARTITION BY link_id, h)
            OR last_ts + INTERVAL 4 DAY <= (SELECT max(ts) FROM readings) AS done FROM batches)
SELECT link_id, CAST(h AS INTEGER) AS hrs, CAST(0 AS INTEGER) AS mins, first_ts, count_rec, avg_volume, avg_speed
FROM ended WHERE done""",
    "moving_archive_stream": f"""WITH {_READINGS}, {_DAILY}
SELECT r.event_id, r.link_id, r.speed, r.volume::DOUBLE AS volume, r.link_id AS hist_link_id,
       round(d.avg_speed, 9) AS avg_speed, round(d.avg_volume, 9) AS avg_volume, r.ts
FROM (SELECT *, hour(ts) AS h FROM readings) r ASOF JOIN daily d
ON r.link_id = d.link_id AND r.h = d.hrs AND r.event_id > d.event_id""",
    "unexpired_stream": f"""WITH {_READINGS}, {_DAILY}
SELECT link_id, hrs, mins, slot, event_id, round(avg_speed, 9) AS avg_speed, round(avg_volume, 9) AS avg_volume
FROM daily WHERE slot >= (
  SELECT date_trunc('minute', arg_max(ts, event_id)) FROM readings WHERE ts < TIMESTAMP '2024-01-30 22:00:00')""",
    "region_links_by_strips": f"WITH {_REGION} SELECT link_id, x, y FROM region",
    "needed_links_join": _FLAGSHIP,
    "floating_throughput": f"""WITH RECURSIVE {_JOINED},
placed AS (
  SELECT ts, date_trunc('hour', ts) + INTERVAL 1 HOUR AS emit_ts, row_number() OVER (ORDER BY ts, event_id) AS place FROM joined),
walk AS (
  SELECT place, ts AS first_ts, 1 AS period, false AS ended FROM placed WHERE place = 1
  UNION ALL
  SELECT p.place, CASE WHEN w.ended THEN p.ts ELSE w.first_ts END, CASE WHEN w.ended THEN w.period + 1 ELSE w.period END,
         NOT w.ended AND p.ts >= w.first_ts + INTERVAL 1 HOUR
  FROM walk w JOIN placed p ON p.place = w.place + 1)
SELECT min(first_ts) AS first_ts, max(ts) AS last_ts, count(*) AS n,
       1000 * count(*) // ((epoch_us(max(ts)) - epoch_us(min(first_ts))) // 1000) AS throughput,
       arg_max(epoch_us(emit_ts) - epoch_us(ts), place) AS latency_us
FROM walk JOIN placed USING (place) GROUP BY period HAVING bool_or(ended)""",
    "recent_minutes_stream": f"""WITH {_READINGS},
minutes AS (
  SELECT event_type AS series, date_trunc('minute', ts) AS minute, arg_max(speed, event_id) AS value FROM readings GROUP BY 1, 2)
SELECT * FROM minutes QUALIFY minute > max(minute) OVER (PARTITION BY series) - INTERVAL 10 MINUTE""",
}
