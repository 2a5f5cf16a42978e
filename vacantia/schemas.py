"""Table schemas (Spark DDL)."""

SALARY = "struct<p25:bigint,median:bigint,p75:bigint,n:bigint>"

POSTING = (
    "company string, company_slug string, title string, location string, remote boolean, "
    "coords struct<lat:double,lng:double>, url string, absolute_url string, departments array<string>, "
    "id string, updated_at string, is_recruiter boolean, ats string, skill_level string, "
    f"workplaceType string, scraped_at timestamp, source string, salary {SALARY}"
)
#: The 12 front-end fields and the types that absent ones get.
SLIM_TYPES = {
    "title": "string", "company": "string", "location": "string", "url": "string", "ats": "string", "skill_level": "string",
    "is_recruiter": "boolean", "workplaceType": "string", "scraped_at": "string", "remote": "boolean",
    "coords": "struct<lat:double,lng:double>", "salary": SALARY,
}
SLIM_COLUMNS = list(SLIM_TYPES)
# the 12 front-end fields as they stand in the chunk files
SLIM_FILE = (
    "title string, company string, location string, url string, ats string, skill_level string, "
    "is_recruiter boolean, workplaceType string, scraped_at string, remote boolean, "
    f"coords array<double>, salary {SALARY}"
)
ALERT_COLUMNS = [
    "job_id", "title", "company", "company_slug", "location", "application_url",
    "date_posted", "platform_source", "skill_level", "is_recruiter",
]
ALERT_JOB = (
    "job_id string, title string, company string, company_slug string, location string, "
    "application_url string, date_posted date, platform_source string, skill_level string, "
    "is_recruiter boolean"
)
VERIFIED_JOB = ALERT_JOB + (
    ", is_live boolean, liveness_checked_at timestamp, salary_posted string, "
    "location_verified string, close_reason string, first_seen date, last_seen date"
)
STATE_SEEN = "job_id string, first_seen date, last_seen date"
PAGE_SNAPSHOT = (
    "url string, final_url string, http_status int, title string, html string, body_text string, "
    "fetch_error string, fetched_at timestamp"
)
RAW_PAYLOAD = (
    "ats string, slug string, page int, offset int, total int, status_code int, "
    "content_type string, body string"
)
PROBE = "platform string, slug string, url string, http_status int, job_count int, probed_at timestamp"
USER_STATUS = "key string, status string, ts timestamp"
