"""The two error types callers need to tell apart."""


class CustomerNotFound(LookupError):
    """No customer carries the requested id."""


class NotEnoughData(ValueError):
    """A fit was asked for on fewer rows than it needs."""

    def __init__(self, required: int, available: int):
        super().__init__(f"need at least {required} rows, found {available}")
        self.required = required
        self.available = available
