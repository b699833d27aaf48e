"""Named queries over the driver's tables."""

from orrery.plans import files, inventory, pictures, ranking, screens, sequence, text  # noqa: F401
from orrery.plans.registry import REGISTRY  # noqa: F401
