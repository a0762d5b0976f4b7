"""What a user can put right is told apart from defects."""


class SelectionError(ValueError):
    """The selection can't be read, or names what the corpus doesn't hold."""


class GenerationError(ValueError):
    """The selection is read but can't fill a paper."""


class ValidationError(ValueError):
    """A paper breaks a rule."""
