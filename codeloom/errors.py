"""Errors by the status that a service would answer with."""

from __future__ import annotations


class AppError(Exception):
    status = 500

    def payload(self) -> dict:
        return {"status": self.status, "title": type(self).__name__, "detail": str(self)}


class BadRequest(AppError):
    status = 400


class NotFound(AppError):
    status = 404


class Conflict(AppError):
    status = 409


class Unprocessable(AppError):
    status = 422


class BadGateway(AppError):
    status = 502


#: Built-in errors and the status each stands for; the first that fits counts.
STATUS: list[tuple[type[BaseException], int]] = [
    (PermissionError, 401),
    (TimeoutError, 504),
    (LookupError, 404),
    (FileNotFoundError, 404),
    (KeyboardInterrupt, 499),
    (NotImplementedError, 400),
    (ValueError, 400),
    (TypeError, 400),
    (RuntimeError, 422),
]


def status_of(error: BaseException) -> int:
    if isinstance(error, AppError):
        return error.status
    return next((status for kind, status in STATUS if isinstance(error, kind)), 500)
