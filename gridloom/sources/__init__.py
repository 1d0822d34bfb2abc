"""Files and services, in and out."""
