"""Errors with a message for the user. All but the group guard are raised before a job is started."""


class SumbrookError(Exception):
    code = "error"


class LoadError(SumbrookError):
    code = "load"


class UnsupportedFormatError(LoadError):
    code = "unsupported"


class EmptyFileError(LoadError):
    code = "empty"


class CorruptFileError(LoadError):
    code = "corrupt"


class NoDataError(LoadError):
    code = "no_data"


class AnalyticsError(SumbrookError):
    code = "analytics"


class DatasetNotFoundError(SumbrookError):
    code = "dataset_not_found"


class WorkflowError(SumbrookError):
    code = "workflow"


class StoreError(SumbrookError):
    code = "store"
