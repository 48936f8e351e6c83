"""Fixed table schemas (DDL)."""

PAGES = "source STRING, url STRING, html STRING, fetched_at TIMESTAMP"
LIST_PAGES = "source STRING, feed INT, list INT, page INT, url STRING, html STRING"
FEEDS = "source STRING, feed INT, list INT, page INT, xml STRING"
PAYLOADS = "source STRING, feed INT, list INT, page INT, json STRING"

LINKS = (
    "source STRING, feed INT, list INT, page INT, pos INT, title STRING, url STRING, list_date_text STRING, "
    "list_date DATE, event_location STRING, list_region STRING, directorate STRING"
)

ANSWER = "struct<ort:string,typ:string,koord:struct<lat:string,lon:string>,bundesland:string,illegal:boolean>"
RESPONSES = "url STRING, response STRING"

GAZETTEER = "name STRING, rank INT, lat DOUBLE, lon DOUBLE"
STATES = "name STRING, rings ARRAY<ARRAY<STRUCT<lon:DOUBLE,lat:DOUBLE>>>"

# What a run appends; ``approved`` is set by moderation outside this package.
INCIDENT_COLUMNS = (
    "title", "summary", "date", "location", "lat", "lon", "url", "federal", "type", "scraper",
)
INCIDENTS = (
    "title STRING, summary STRING, date DATE, location STRING, lat DOUBLE, lon DOUBLE, url STRING, "
    "federal STRING, type STRING, scraper BOOLEAN, approved BOOLEAN"
)

SUBMISSIONS = "id BIGINT, method STRING, body STRING, captcha_success BOOLEAN, captcha_score DOUBLE"
RUN_LOG = "run_id STRING, source STRING, exit_code INT, output STRING"
REJECTS = "source STRING, url STRING, reason STRING"
