"""Machine-telemetry trace pipeline expressed as DataFrame-to-DataFrame functions."""
