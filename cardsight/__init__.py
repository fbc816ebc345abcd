"""cardsight: card-fraud analytics as Spark DataFrame / SQL / MLlib jobs.

Every public function takes and returns ``DataFrame``s; parameters are plain
arguments and "now" is always an explicit ``as_of`` argument.
"""

from cardsight.session import build_session, checkpoint_dir

__all__ = ["build_session", "checkpoint_dir"]
