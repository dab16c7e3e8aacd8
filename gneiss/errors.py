"""Errors as stable values for callers: a code, whether it may help to repeat, and what to do next."""

from __future__ import annotations

from gneiss.api import UnsupportedCapability
from gneiss.streaming.embedding import error_kind

# Codes and whether a repeated call may succeed.
CODES = {
    "CONFIG_INVALID": False,
    "INPUT_VALIDATION": False,
    "UNSUPPORTED_OPERATION": False,
    "UNSUPPORTED_CAPABILITY": False,
    "RESOURCE_NOT_FOUND": False,
    "PERMISSION_DENIED": False,
    "TIMEOUT": True,
    "RATE_LIMITED": True,
    "UPSTREAM_ERROR": True,
    "INTERNAL_ERROR": False,
}
_STEPS = {
    "CONFIG_INVALID": ["Check the settings file and the paths it names."],
    "INPUT_VALIDATION": ["Correct the fields that the message names."],
    "UNSUPPORTED_OPERATION": ["Use one of the operations that the message lists."],
    "UNSUPPORTED_CAPABILITY": ["Search by text, or build an index with a source mode that has the capability."],
    "RESOURCE_NOT_FOUND": ["Check the path or the identifier."],
    "PERMISSION_DENIED": ["Ask for access to the table or folder."],
    "TIMEOUT": ["Repeat the call, with a smaller request if it times out again."],
    "RATE_LIMITED": ["Wait, then repeat the call."],
    "UPSTREAM_ERROR": ["Repeat the call later."],
    "INTERNAL_ERROR": ["Report the message."],
}
_BY_KIND = {"rate_limit": "RATE_LIMITED", "timeout": "TIMEOUT", "network": "UPSTREAM_ERROR", "server_error": "UPSTREAM_ERROR", "http_error": "UPSTREAM_ERROR"}
#: Characters of a message that leave.
MOST_MESSAGE = 4000


def described(error: BaseException, secret_paths: tuple[str, ...] = ()) -> dict[str, object]:
    """{code, message, retryable, next_steps}; paths of the deployment are blanked in the message."""
    if isinstance(error, UnsupportedCapability):
        code = "UNSUPPORTED_CAPABILITY"
    elif isinstance(error, ValueError):
        code = "UNSUPPORTED_OPERATION" if "one of" in str(error) else "INPUT_VALIDATION"
    elif isinstance(error, FileNotFoundError):
        code = "RESOURCE_NOT_FOUND"
    elif isinstance(error, PermissionError):
        code = "PERMISSION_DENIED"
    else:
        code = _BY_KIND.get(error_kind(error) if isinstance(error, Exception) else "other", "INTERNAL_ERROR")
    message = str(error)
    for path in secret_paths:
        message = message.replace(path, "<path>")
    return {"code": code, "message": message[:MOST_MESSAGE], "retryable": CODES[code], "next_steps": _STEPS[code]}
