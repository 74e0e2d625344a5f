"""Settings of a crawl pipeline; frozen, with defaults, overridable by keyword."""

from __future__ import annotations

from dataclasses import dataclass, fields, replace


@dataclass(frozen=True)
class Settings:
    """Every setting that has a meaning without sockets and processes; times in seconds."""

    user_agent: str = "linkflow/0.1"
    follow_redirects: bool = False
    max_redirects: int = 3
    fetch_concurrency: int = 10
    request_timeout: float = 20.0
    connect_timeout: float = 20.0
    validate_certificates: bool = True
    proxy: str | None = None
    static_dns: tuple[tuple[str, tuple[str, int]], ...] = ()
    mode: str = "multi"
    tick_seconds: int = 60
    #: Urls of a ready set; None: one of every queue that may work.
    ready_limit: int | None = 500
    crawl_delay_factor: float = 4.0
    min_delay: float = 5.0
    active_queues: int = 100
    queue_budget: int = 50
    budget_punish: int = 5
    num_priorities: int = 10
    crawl_delta: int = 86_400
    assignment: str = "host"
    max_element: int = 64
    scope_positive: tuple[str, ...] = ()
    scope_negative: tuple[str, ...] = ()
    not_found_redirects: tuple[str, ...] = ()
    remove_anchors: bool = True
    unique_hash: str = "sha1"
    #: True reproduces the reference where we deliberately differ (redirects ignored, their targets not enqueued).
    compat: bool = False

    def override(self, **values) -> Settings:
        """A copy with other values; an unknown name is an error."""
        unknown = set(values) - {f.name for f in fields(self)}
        if unknown:
            raise ValueError(f"unknown settings: {sorted(unknown)}")
        return replace(self, **values)
