"""Written intermediate tables: the core's, under the name that this subpackage uses."""

from contextmill.sources.scratch import Scratch, shared_root

__all__ = ["Scratch", "shared_root"]
