"""The per-page checks."""

from .accessibility import accessibility_issues, check_accessibility
from .console import check_console_errors, console_issues
from .forbidden import (
    check_forbidden_hosts, forbidden_issues, has_forbidden_host, scan_text_files,
)
from .http_status import check_http_status, detect_block, http_status_issues, is_rate_limited
from .links import check_links, link_targets
from .media import check_images, check_mixed_content, image_issues, mixed_content_issues
from .seo import check_seo, seo_issues

# Checks that need nothing but the capture row, in report order.
ROW_CHECKS = {
    "http-status": http_status_issues,
    "console-errors": console_issues,
    "forbidden-hosts": forbidden_issues,
    "seo": seo_issues,
    "mixed-content": mixed_content_issues,
    "images": image_issues,
    "accessibility": accessibility_issues,
}

__all__ = [
    "ROW_CHECKS", "check_accessibility", "check_console_errors", "check_forbidden_hosts",
    "check_http_status", "check_images", "check_links", "check_mixed_content", "check_seo",
    "detect_block", "has_forbidden_host", "is_rate_limited", "link_targets", "scan_text_files",
]
