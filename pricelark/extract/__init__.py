"""Raw listing pages and pricing responses to snapshots."""

from pyspark import cloudpickle

from pricelark.extract import markup

# the helper travels with the functions that use it, so executors need no package install
cloudpickle.register_pickle_by_value(markup)
