"""A PySpark engine that turns source trees and text blobs into an evidence-carrying code graph."""
