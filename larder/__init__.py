"""larder: retail store analytics as lazy Spark DataFrame operators.

Every operator takes a mapping of table name -> DataFrame (see
``larder.sources``) plus plain Python arguments and returns a DataFrame.
Nothing is collected to the driver; the clock is always an argument.
"""

from larder.session import build_session, checkpoint_dir

__all__ = ["build_session", "checkpoint_dir"]
