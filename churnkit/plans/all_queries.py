"""Importing this module registers every query."""

from . import q_prep  # noqa: F401
from . import q_profile  # noqa: F401
from . import q_metrics  # noqa: F401
from . import q_ensemble  # noqa: F401
from . import q_cluster  # noqa: F401
from . import q_models, q_panel, q_checks  # noqa: F401
