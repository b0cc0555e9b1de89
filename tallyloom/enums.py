"""Fixed vocabularies: the texts that columns hold."""

from __future__ import annotations

from enum import StrEnum


class Discrepancy(StrEnum):
    MISSING_IN_SOURCE = "MissingInSource"
    MISSING_IN_TARGET = "MissingInTarget"
    AMOUNT_MISMATCH = "AmountMismatch"
    DATE_MISMATCH = "DateMismatch"
    DUPLICATE_IN_SOURCE = "DuplicateInSource"
    DUPLICATE_IN_TARGET = "DuplicateInTarget"
    SPLIT_PAYMENT = "SplitPayment"
    CONSOLIDATED_PAYMENT = "ConsolidatedPayment"


class Strategy(StrEnum):
    EXACT = "Exact"
    FUZZY = "Fuzzy"
    PARTIAL = "Partial"


class Status(StrEnum):
    COMPLETED = "Completed"
    PARTIALLY_COMPLETED = "PartiallyCompleted"


class ResultKind(StrEnum):
    MATCHED = "Matched"
    UNMATCHED = "Unmatched"


class FileFormat(StrEnum):
    CSV = "Csv"
    JSON = "Json"
    MT940 = "Mt940"


class ErrorType(StrEnum):
    MALFORMED_ROW = "MalformedRow"
    INVALID_AMOUNT = "InvalidAmount"
    INVALID_DATE = "InvalidDate"
    NORMALIZATION_FAILED = "NormalizationFailed"


class ErrorCode(StrEnum):
    INVALID_TRANSACTION = "INVALID_TRANSACTION"
