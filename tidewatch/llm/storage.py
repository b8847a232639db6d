"""Tables written once and read again, in the folder that the cluster shares."""

from __future__ import annotations

from tidewatch.sources.storage import materialize, shared_folder  # noqa: F401
