from . import editors  # noqa: F401  (its formats are known to readers and writers once the package is loaded)
