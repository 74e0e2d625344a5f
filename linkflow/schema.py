"""Schemas of the tables."""

from __future__ import annotations

CRAWL_URI = (
    "fetch_id long, url string, effective_url string, current_priority int, begin_processing long, end_processing long, "
    "req_header map<string,string>, rep_header map<string,string>, content_body binary, status_code int, req_time double, "
    "queue_time double, optional_vars map<string,string>"
)
FRONTIER_SINGLE = "url string, etag string, mod_date long, next_date long, priority int"
FRONTIER = "url string, queue long, etag string, mod_date long, next_date long, priority int"
QUEUES = "queue long, identifier string"
HOST_STATE = "queue long, budget int, not_before long, in_heap boolean"
DNS = "host_port string, ip string, port int"
#: ``next_date`` up to this value means: ignored, and the value is the HTTP status.
IGNORED = 1000
