"""See the package README."""

from hypnoframe.plans import session, commands, signals, staging  # noqa: E402, F401, I001  in this order; the latter three register the commands
